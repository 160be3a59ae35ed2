"""Filling containers of fixed capacity with items, with little unused space.

Method: swap-based local search. Items of one capacity are dealt at random to groups of about GROUP,
each packed in one task. A group is first packed best-fit, largest item first; then, from the emptiest
bin on, items are moved, exchanged one for one or two for one between underfull bins whenever that
increases the sum of squared fills, which drains bins until they can be dropped. The search ends at
the least possible number of bins or when nothing helps. The space lost to grouping is below one
bin a group, that is below one in some thousands.

Items longer than the capacity, and no others, are divided: into pieces of the full capacity, each a bin of
its own, and a rest that is packed like any item. Groups are bounded, so skew does not arise.

Defined results: items without size (null or empty texts) need no container and appear in none;
capacities that are null or not positive are ignored; of repeated ids the rows are separate items;
equal sizes are packed in the order of their ids; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import materialise

GROUP = 10_000
PASSES = 3
PAIRS = 32
MOST_PACKS = 1_000


def best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that takes it."""
    order = np.argsort(-size, kind="stable")
    bins = np.empty(len(size), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in order:
        s = int(size[i])
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, count
            count += 1
        bins[i] = b
        free[r - s].append(b)
        mask |= 1 << (r - s)
    return bins


def drain(size: np.ndarray, bins: np.ndarray, capacity: int, seed: int = 3) -> np.ndarray:
    """Local search from a packing; the bins of the result are numbered from 0."""
    bins = bins.copy()
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, size, n_bins).astype(np.int64)
    least = -(-int(size.sum()) // capacity)
    alive = n_bins
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        if alive <= least:
            break
        before = (alive, int((fill * fill).sum()))
        loose = np.flatnonzero((fill[bins] < capacity))
        s, home = size[loose], bins[loose]
        room = capacity - fill
        for b in np.argsort(fill, kind="stable"):
            if fill[b] == 0 or fill[b] == capacity or alive <= least:
                continue
            tries = 0
            while fill[b] > 0 and tries < 64:
                tries += 1
                mine = np.flatnonzero(home == b)
                if not len(mine):
                    break
                done = False
                for i in mine[np.argsort(-s[mine], kind="stable")]:  # moves
                    fits = np.flatnonzero((room >= s[i]) & (fill > 0) & (fill + s[i] > fill[b]))
                    fits = fits[fits != b]
                    if len(fits):
                        o = fits[np.argmin(room[fits])]
                        _shift(home, fill, room, [i], o, [], b, s)
                        done = True
                        break
                if done:
                    continue
                takes = s + room[home]  # the largest item that can stand in each one's place
                other = (home != b) & (room[home] > 0)
                singles = [[i] for i in mine]
                if len(mine) > 1:
                    if len(mine) * (len(mine) - 1) // 2 <= PAIRS:
                        singles += [[mine[x], mine[y]] for x in range(len(mine)) for y in range(x)]
                    else:
                        singles += [list(rng.choice(mine, 2, replace=False)) for _ in range(PAIRS)]
                best, move = 0, None
                for give in singles:  # one for one, two for one
                    g = int(s[give].sum())
                    j = np.flatnonzero(other & (takes >= g) & (s < g))
                    if len(j):
                        gain = g - s[j]
                        gain = np.where(fill[home[j]] + gain > fill[b], gain, 0)
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, move = int(gain[k]), (give, j[k])
                if move is None:
                    break
                give, j = move
                _shift(home, fill, room, give, home[j], [j], b, s)
            if fill[b] == 0:
                alive -= 1
        bins[loose] = home
        if (alive, int((fill * fill).sum())) == before:
            break
    return np.unique(bins, return_inverse=True)[1]


def _shift(home, fill, room, give, o, take, b, s) -> None:
    """Items ``give`` of bin b go to bin o, items ``take`` of o to b."""
    change = int(s[list(give)].sum()) - (int(s[list(take)].sum()) if len(take) else 0)
    home[list(give)] = o
    if len(take):
        home[list(take)] = b
    fill[o] += change
    fill[b] -= change
    room[o] -= change
    room[b] += change


def _pack(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["doc_id", "piece"], ignore_index=True)
    capacity, size = int(f["capacity"].iloc[0]), f["n_tokens"].to_numpy(np.int64)
    full = size == capacity
    bins = np.empty(len(f), np.int64)
    bins[full] = np.arange(full.sum())
    if (~full).any():
        bins[~full] = full.sum() + drain(size[~full], best_fit(size[~full], capacity), capacity)
    return f.assign(bin=bins)


def pack(sizes: DataFrame, capacities: DataFrame, group: int = GROUP) -> DataFrame:
    """(pack_id, bin_id, doc_id, piece, first_token, n_tokens): every token of every document in one bin of each capacity.

    ``sizes`` (doc_id, n_tokens) must be a stored table.
    """
    packs = capacities.select("pack_id", F.col("capacity").cast("long").alias("capacity")).where("pack_id is not null and capacity > 0").distinct()
    if packs.limit(MOST_PACKS + 1).count() > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    items = sizes.select("doc_id", "n_tokens").where("n_tokens > 0").join(F.broadcast(packs))
    parts = F.expr("transform(sequence(0, cast((n_tokens - 1) div capacity as int)), i -> struct(i as piece, i * capacity as first_token, least(capacity, n_tokens - i * capacity) as size))")
    items = items.select("pack_id", "capacity", "doc_id", F.explode(parts).alias("p")).select("pack_id", "capacity", "doc_id", "p.piece", "p.first_token", F.col("p.size").alias("n_tokens"))
    counts = items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()
    dealt = F.create_map(*[F.lit(x) for r in counts for x in (r["pack_id"], -(-r["n"] // group))]) if counts else F.create_map(F.lit(0), F.lit(1))
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(dealt.cast("map<int,bigint>"), F.col("pack_id").cast("int"))))
    form = "pack_id int, capacity long, doc_id long, piece int, first_token long, n_tokens long, grp long, bin long"
    packed = items.select(F.col("pack_id").cast("int").alias("pack_id"), "capacity", "doc_id", "piece", F.col("first_token").cast("long").alias("first_token"), F.col("n_tokens").cast("long").alias("n_tokens"), "grp")
    # a stated number of partitions: rows are few for the work they make, and would be put into one task
    parts = min(sum(-(-r["n"] // group) for r in counts) or 1, 10_000)
    packed = packed.repartition(parts, "pack_id", "grp").groupBy("pack_id", "grp").applyInPandas(_pack, form)
    return packed.select("pack_id", F.format_string("%d-%d-%d", "pack_id", "grp", "bin").alias("bin_id"), "doc_id", "piece", "first_token", "n_tokens")


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: documents, divided documents, bins, the least number of bins there could be and the distance to it, and the share of space used."""
    bins = materialise(packed, "packed").groupBy("pack_id").agg(
        F.countDistinct("bin_id").alias("n_bins"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct(F.when(F.col("piece") > 0, F.col("doc_id"))).alias("n_divided"), F.sum("n_tokens").alias("n_tokens")
    )
    caps = capacities.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity").cast("long").alias("capacity")).distinct()
    out = F.broadcast(caps).join(bins, "pack_id", "left").fillna(0)
    return out.select("pack_id", "capacity", "n_documents", "n_divided", "n_tokens", "n_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), (F.col("n_bins") - F.ceil(F.col("n_tokens") / F.col("capacity"))).alias("bins_above_least"), F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.col("n_bins") * F.col("capacity")), F.lit(0.0)), 6).alias("share_used"))
