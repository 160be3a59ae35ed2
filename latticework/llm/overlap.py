"""Same or near-same records across splits.

Two point sets of equal size are near-same if their points can be paired one to one so that the
two of each pair differ by at most ``eps`` in x and in y.

Method: minwise hashing of shingles, banded buckets, only train-against-evaluation candidates,
exact Jaccard similarity of the candidates, and then the exact pairing.

A shingle is a point's cell in one of ``SHIFTS`` grids of width ``WIDTH``, each shifted by
WIDTH/SHIFTS against the one before, with a counter for points that share a cell. Cell borders
of all grids lie WIDTH/SHIFTS apart, which exceeds ``eps``; moving a point by at most eps in x
and y so crosses at most one border in each and changes at most two of its SHIFTS cells. Near-same
sets of n points hence share at least n(SHIFTS-2) of at most n(SHIFTS+2) shingles: with 18 grids
their Jaccard similarity is at least 0.8, and the exact Jaccard check loses none of them. The
minwise values come from one permutation cut into BANDS x ROWS bins. Pairs that differ by the full
eps in every coordinate have an expected similarity of about 0.96, for which the eight bands miss
about 3 in 10 million.

Exact copies are one class from the start, so a hot group of copies enters a bucket once. A
bucket is further split by the number of points and the cell of the mean point (means of
near-same sets differ by at most eps; the evaluation side is entered in each cell within eps), so
bucket pairs differ by at most eps in their means. The band join leaves
skewed buckets to be split at run time (an inner sort-merge join); on expansion the members of both
sides of large classes come in parts.

Defined results: ids that are no reference, null or unknown splits, null point sets, sets with
null or non-finite coordinates and sets of fewer than ``least`` points take no part in the near
comparison; equal ids do so without any points. Repeated rows count once. An id with several
point sets is near-same by any of them. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.ids import id_key
from latticework.session import materialise

EPS = 0.005
LEAST = 8
WIDTH = 0.5
SHIFTS = 18
BANDS, ROWS = 8, 4
MEAN_CELL = 0.1
JACCARD = 0.8
#: Members of one class that go to one task on expansion.
SALT_EVERY = 2_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a well-spread permutation of the integers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all shingles of points (P x 2) that belong to owners (P)."""
    shift = np.arange(SHIFTS) * (WIDTH / SHIFTS)
    cells = np.floor((points[:, None, :] + shift[None, :, None]) / WIDTH).astype(np.int64)
    with np.errstate(over="ignore"):
        code = mix(cells[..., 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(cells[..., 1].astype(np.uint64)) + np.arange(SHIFTS, dtype=np.uint64)[None])
    own, code = np.repeat(owner, SHIFTS), code.ravel()
    order = np.lexsort((code, own))
    own, code = own[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
    at = np.arange(len(code))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    with np.errstate(over="ignore"):
        return own, mix(code + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signatures(points: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Minwise values (n_owners x BANDS*ROWS) by one permutation; an empty bin takes the next filled one's value."""
    bins = BANDS * ROWS
    own, code = shingles(points, owner)
    low = np.full(n_owners * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(low, own * bins + (code % np.uint64(bins)).astype(np.int64), code // np.uint64(bins))
    low = low.reshape(n_owners, bins)
    for step in range(1, bins):
        empty = low == np.iinfo(np.uint64).max
        if not empty.any():
            break
        low = np.where(empty, np.roll(low, -1, axis=1), low)
    return low


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, points) -> (key, cls, n, pts): points sorted, as bytes; cls is their hash."""
    import xxhash

    for b in batches:
        keys, cls, ns, pts = [], [], [], []
        col = b.column("latent_space")
        for key, cell in zip(b.column("key").to_pylist(), range(len(col)), strict=True):
            v = col[cell].values
            if v is None or len(v) < LEAST or v.null_count:
                continue
            flat = v.flatten()
            if flat.null_count or len(flat) != 2 * len(v) or not (np.diff(v.offsets.to_numpy()) == 2).all():
                continue
            a = flat.to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, 2) + np.float32(0)
            if not np.isfinite(a).all():
                continue
            raw = a[np.lexsort((a[:, 1], a[:, 0]))].tobytes()
            keys.append(key)
            cls.append(xxhash.xxh3_128_digest(raw))
            ns.append(len(a))
            pts.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(cls, pa.binary()), pa.array(ns, pa.int32()), pa.array(pts, pa.binary())], names=["key", "cls", "n", "pts"])


def _bands(frames: Iterator[pd.DataFrame], train: bool) -> Iterator[pd.DataFrame]:
    """(cls, n, pts) of one side -> (cls, mx, my, bucket); the evaluation side stands in every near mean cell."""
    for f in frames:
        if not len(f):
            continue
        f = f.reset_index(drop=True)
        n = f["n"].to_numpy(np.int64)
        points = np.frombuffer(b"".join(f["pts"]), "<f4").reshape(-1, 2).astype(np.float64)
        owner = np.repeat(np.arange(len(f)), n)
        sig = signatures(points, owner, len(f))
        with np.errstate(over="ignore"):
            band = np.zeros((len(f), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(31) + sig[:, r::ROWS])
            band = mix(band + mix(n.astype(np.uint64))[:, None] + np.arange(BANDS, dtype=np.uint64)[None])
        mean = np.stack([np.bincount(owner, points[:, a]) / n for a in (0, 1)], 1)
        out = []
        for sx in (0,) if train else (-1, 0, 1):
            for sy in (0,) if train else (-1, 0, 1):
                move, base = np.array([sx, sy]) * (EPS + 1e-6), np.floor(mean / MEAN_CELL)
                cell = np.floor((mean + move) / MEAN_CELL).astype(np.int64)
                k = np.flatnonzero(((cell != base) == (np.array([sx, sy]) != 0)).all(1))
                with np.errstate(over="ignore"):
                    where = mix(cell[k, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(cell[k, 1].astype(np.uint64)))
                    bucket = (band[k] ^ where[:, None]).view(np.int64)
                k = np.repeat(k, BANDS)
                out.append(pd.DataFrame({"cls": f["cls"].to_numpy(object)[k], "mx": mean[k, 0], "my": mean[k, 1], "bucket": bucket.ravel()}))
        yield pd.concat(out, ignore_index=True)


def pairing(near: list[np.ndarray]) -> bool:
    """Whether every left point can have its own right point; near[i]: the right points that i may take."""
    owner: dict[int, int] = {}
    for start in sorted(range(len(near)), key=lambda i: len(near[i])):
        came: dict[int, int] = {}
        stack, free = [start], None
        while stack and free is None:
            i = stack.pop()
            for j in map(int, near[i]):
                if j in came:
                    continue
                came[j] = i
                if j not in owner:
                    free = j
                    break
                stack.append(owner[j])
        if free is None:
            return False
        left = {i: j for j, i in owner.items()}
        while True:
            i = came[free]
            before = left.get(i)
            owner[free] = i
            if i == start:
                break
            free = before
    return True


def near_same(a: np.ndarray, b: np.ndarray, eps: float = EPS) -> np.ndarray:
    """For pairs of point sets (B x n x 2, each): whether they are near-same."""
    tol = eps * (1 + 1e-9)
    out = np.zeros(len(a), bool)
    n = a.shape[1]
    if n > 1024:
        for p in range(len(a)):
            order = np.argsort(b[p, :, 0], kind="stable")
            xs = b[p, order, 0]
            lo, hi = np.searchsorted(xs, a[p, :, 0] - tol), np.searchsorted(xs, a[p, :, 0] + tol, side="right")
            near = [order[s:e][np.abs(b[p, order[s:e], 1] - y) <= tol] for s, e, y in zip(lo, hi, a[p, :, 1], strict=True)]
            out[p] = all(map(len, near)) and pairing(near)
        return out
    step = max(1, 2_000_000 // (n * n))
    for s in range(0, len(a), step):
        x, y = a[s : s + step], b[s : s + step]
        close = (np.abs(x[:, :, None, 0] - y[:, None, :, 0]) <= tol) & (np.abs(x[:, :, None, 1] - y[:, None, :, 1]) <= tol)
        rows, cols = close.sum(2), close.sum(1)
        some = (rows > 0).all(1) & (cols > 0).all(1)
        one = some & (rows == 1).all(1)
        out[s : s + step] = one
        for p in np.flatnonzero(some & ~one):
            out[s + p] = pairing([np.flatnonzero(r) for r in close[p]])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the shingles of pairs of point sets (B x n x 2, each)."""
    count, n = len(a), a.shape[1]
    owner = np.repeat(np.arange(count), n)
    own_a, sa = shingles(a.reshape(-1, 2), owner)
    own_b, sb = shingles(b.reshape(-1, 2), owner)
    own, code = np.concatenate([own_a, own_b]), np.concatenate([sa, sb])
    order = np.lexsort((code, own))
    own, code = own[order], code[order]
    same = np.bincount(own[1:][(code[1:] == code[:-1]) & (own[1:] == own[:-1])], minlength=count)
    return same / (2 * n * SHIFTS - same)


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = []
        for n, g in f.groupby("n"):
            for s in range(0, len(g), 2_000):
                part = g.iloc[s : s + 2_000]
                a, b = (np.frombuffer(b"".join(part[c]), "<f4").reshape(len(part), int(n), 2).astype(np.float64) for c in ("pts_t", "pts_e"))
                good = np.flatnonzero(jaccard(a, b) >= JACCARD)
                good = good[near_same(a[good], b[good])] if len(good) else good
                keep.append(part.iloc[good][["cls_t", "cls_e"]])
        yield pd.concat(keep, ignore_index=True) if keep else pd.DataFrame({"cls_t": [], "cls_e": []}, dtype=object)


def members(rows: DataFrame) -> DataFrame:
    """(key, split, source): the distinct members; a null source is written ``unknown``."""
    split = F.lower(F.regexp_replace("split_name", r"[\s ​]+", ""))
    return rows.select(id_key("atl_id").alias("key"), split.alias("split"), F.coalesce("source", F.lit("unknown")).alias("source")).where("key is not null and split in ('train', 'valid', 'test')").distinct()


def overlaps(split_members: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(split, train_key, eval_key): every overlap, distinct; equal keys are the same id."""
    who = members(split_members).select("key", "split").distinct()
    flags = who.groupBy("key").agg(*[F.max(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])
    sets = descriptors.select(id_key("atl_id").alias("key"), "latent_space").where("key is not null").where(F.size("latent_space") >= LEAST)
    sets = sets.join(flags.select("key"), "key", "left_semi").mapInArrow(_clean, "key string, cls binary, n int, pts binary")
    sets = materialise(sets, "points")
    held = materialise(sets.select("key", "cls").distinct().join(flags, "key"), "held")
    role = held.groupBy("cls").agg(F.max("train").alias("train"), F.max(F.col("valid") | F.col("test")).alias("evals"), F.sum(F.col("train").cast("long")).alias("n_train"), F.sum((F.col("valid") | F.col("test")).cast("long")).alias("n_evals"))
    points = sets.groupBy("cls").agg(F.min(F.struct("n", "pts")).alias("p")).select("cls", "p.n", "p.pts")
    classes = materialise(points.join(role, "cls").where("train or evals"), "classes")
    form, near_mean = "cls binary, mx double, my double, bucket long", EPS + 1e-6
    left = classes.where("train").select("cls", "n", "pts").mapInPandas(lambda f: _bands(f, True), form).toDF("cls_t", "mx", "my", "bucket")
    right = classes.where("evals").select("cls", "n", "pts").mapInPandas(lambda f: _bands(f, False), form).toDF("cls_e", "ex", "ey", "bucket")
    found = left.join(right, "bucket").where("cls_t != cls_e").where(F.abs(F.col("mx") - F.col("ex")) <= near_mean).where(F.abs(F.col("my") - F.col("ey")) <= near_mean)
    found = found.select("cls_t", "cls_e").distinct()
    pts = classes.select("cls", "n", "pts")
    found = found.join(pts.toDF("cls_t", "n", "pts_t"), "cls_t").join(pts.select("cls", "pts").toDF("cls_e", "pts_e"), "cls_e").where(F.length("pts_t") == F.length("pts_e"))
    near = found.mapInPandas(_verify, "cls_t binary, cls_e binary")
    near = near.unionByName(classes.where("train and evals").select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_e")))
    parts = lambda c: F.ceil(F.col(c) / SALT_EVERY).cast("int")
    salts = classes.select("cls", parts("n_train").alias("ts"), parts("n_evals").alias("es"))
    trains = held.where("train").select(F.col("cls").alias("cls_t"), F.col("key").alias("train_key")).join(salts.select(F.col("cls").alias("cls_t"), "ts"), "cls_t").select("cls_t", "train_key", F.pmod(F.hash("train_key"), "ts").alias("t"))
    split = F.explode(F.filter(F.array(F.when(F.col("valid"), "valid"), F.when(F.col("test"), "test")), lambda x: x.isNotNull()))
    evals = held.where("valid or test").select(F.col("cls").alias("cls_e"), F.col("key").alias("eval_key"), split.alias("split")).join(salts.select(F.col("cls").alias("cls_e"), "es"), "cls_e")
    evals = evals.select("cls_e", "eval_key", "split", F.pmod(F.hash("eval_key"), "es").alias("e"))
    # members of both sides come in parts, and every part of one meets every part of the other
    pairs = near.join(salts.select(F.col("cls").alias("cls_e"), "es"), "cls_e").join(salts.select(F.col("cls").alias("cls_t"), "ts"), "cls_t")
    pairs = pairs.select("cls_t", "cls_e", F.explode(F.expr("sequence(0, es - 1)")).alias("e"), "ts").select("cls_t", "cls_e", "e", F.explode(F.expr("sequence(0, ts - 1)")).alias("t"))
    pairs = pairs.join(evals, ["cls_e", "e"]).join(trains, ["cls_t", "t"]).where("train_key != eval_key").select("split", "train_key", "eval_key")
    same = who.where("split != 'train'").join(who.where("split = 'train'").select("key"), "key").select("split", F.col("key").alias("train_key"), F.col("key").alias("eval_key"))
    return pairs.distinct().unionByName(same)


def overlap_report(found: DataFrame, split_members: DataFrame) -> DataFrame:
    """Per evaluation split and source: members, those that stand in train by id, and by near-same points."""
    per = found.groupBy("split", F.col("eval_key").alias("key")).agg(F.max((F.col("train_key") == F.col("eval_key")).cast("int")).alias("same"), F.max((F.col("train_key") != F.col("eval_key")).cast("int")).alias("near"), F.count(F.lit(1)).alias("pairs"))
    base = members(split_members).where("split != 'train'").join(per, ["split", "key"], "left")
    whole = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(n) for c, n in (("same", "n_same_id"), ("near", "n_near_same"), ("pairs", "n_pairs"))]
    touched = F.sum((F.coalesce("same", F.lit(0)) + F.coalesce("near", F.lit(0)) > 0).cast("long")).alias("n_overlapping")
    return base.groupBy(F.col("split").alias("split_name"), "source").agg(F.count(F.lit(1)).alias("n_members"), *whole, touched)
