"""A varied subset of given size.

Method: max-sum dispersion by local search over composable core-sets. Each partition streams its rows
and keeps, for every request, a core-set: the farthest-first points and, beside them, the points that a
local search for the largest sum of distances picks. Core-sets of core-sets are core-sets, so they are
merged in rounds of FAN until one task can hold a request's candidates (LIMIT). There the subset starts
as the farthest-first points, and selected and unselected candidates are swapped while the sum of all
pairwise distances grows.

The distance is the one between unit vectors plus BONUS for another phase and BONUS for another struct
type (a sum of metrics is a metric), so variety counts in all three. Sums alone would let the subset
fill with members of a few far-away groups; a candidate is therefore swapped in only if it keeps the
separation: half the least distance among the farthest-first points, and no less than that of
cosine 0.97. Large groups of similar structures so give as many members as they have distinct places.

``represented`` gives every candidate of a request its nearest selected structure and the distance, so
that the cover of the variety can be judged row by row.

Defined results: structures that are there (see ``sampling.current``) with a usable vector (see
``neighbours.vectors``) can be selected, each once; a request that asks for more than there are gets
all; a null, unknown or nonpositive size gives nothing; ties go to the smaller id; empty tables give
empty results; extra columns are ignored. Subsets of more than LIMIT, and more than MOST_SELECTED rows in
all requests together, are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.neighbours import normalised, vectors
from latticework.llm.sampling import category, current
from latticework.session import materialise

BONUS = 0.25
NEAR = math.sqrt(2 - 2 * 0.97)
FAN = 32
LIMIT = 20_000
MOST_REQUESTS, MOST_SELECTED = 10_000, 200_000
ROW = "request_id int, part long, key string, phase string, struct_type string, vec binary"


class Points:
    """Unit vectors with two labels, and their distances to one of them."""

    def __init__(self, f: pd.DataFrame) -> None:
        self.x = np.frombuffer(b"".join(f["vec"]), "<f4").reshape(len(f), -1)
        self.labels = [pd.factorize(f[c].fillna(""))[0] for c in ("phase", "struct_type")]

    def to(self, i: int) -> np.ndarray:
        d = np.sqrt(np.maximum(2 - 2 * (self.x @ self.x[i]), 0))
        return d + sum(BONUS * (lab != lab[i]) for lab in self.labels)

    def among(self, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Mean and least distance of each to the others, by blocks; 0 for a single point."""
        n = len(self.x)
        mean, least = np.zeros(n), np.zeros(n)
        for s in range(0, n if n > 1 else 0, step):
            d = np.sqrt(np.maximum(2 - 2 * (self.x[s : s + step] @ self.x.T).astype(float), 0))
            d += sum(BONUS * (lab[s : s + step, None] != lab[None]) for lab in self.labels)
            at = np.arange(len(d))
            d[at, s + at] = 0
            mean[s : s + step] = d.sum(1) / (n - 1)
            d[at, s + at] = np.inf
            least[s : s + step] = d.min(1)
        return mean, least


def farthest(p: Points, k: int) -> tuple[list[int], float]:
    """k points, each the farthest from those before, and the least distance among them."""
    got, least = [0], math.inf
    near = p.to(0)
    while len(got) < min(k, len(p.x)):
        near[got[-1]] = -1
        i = int(np.argmax(near))
        least = min(least, float(near[i]))
        got.append(i)
        near = np.minimum(near, p.to(i))
    return got, least


def swaps(p: Points, start: list[int], apart: float, passes: int = 8) -> list[int]:
    """Local search: swap a selected for an unselected point while the sum of distances grows and points stay apart."""
    selected = list(start)
    inside = np.zeros(len(p.x), bool)
    inside[selected] = True
    total, close = np.zeros(len(p.x)), np.zeros(len(p.x), int)
    for i in selected:
        d = p.to(i)
        total += d
        close += d < apart
    for _ in range(passes):
        moved = False
        for at in sorted(range(len(selected)), key=lambda a: total[selected[a]]):
            o = selected[at]
            d = p.to(o)
            free = ~inside & (close - (d < apart) == 0)
            if not free.any():
                continue
            worth = np.where(free, total - d, -np.inf)
            i = int(np.argmax(worth))
            if worth[i] > total[o] + 1e-6 * max(1.0, total[o]):
                e = p.to(i)
                total += e - d
                close += (e < apart).astype(int) - (d < apart)
                inside[o], inside[i], selected[at], moved = False, True, i, True
        if not moved:
            break
    return selected


def core(f: pd.DataFrame, k: int) -> pd.DataFrame:
    """A core-set of a request's candidates: at most 2k of them."""
    f = f.drop_duplicates("key").sort_values("key", ignore_index=True)
    if len(f) <= 2 * k:
        return f
    p = Points(f)
    got, least = farthest(p, k)
    return f.iloc[sorted({*got, *swaps(p, got, max(least / 2, NEAR), passes=2)})]


def _cores(requests: list[tuple]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list[pd.DataFrame]] = {}
        for f in frames:
            f = f.assign(vec=[r.tobytes() for r in normalised(np.frombuffer(b"".join(f["vec"]), "<f4").reshape(len(f), -1))]) if len(f) else f
            for rid, phase, kind, k in requests:
                fits = f[(f["phase"].eq(phase) if phase is not None else True) & (f["struct_type"].eq(kind) if kind is not None else True)] if phase is not None or kind is not None else f
                if len(fits):
                    have = held.setdefault(rid, [])
                    have.append(fits)
                    if sum(map(len, have)) > 4 * k + 2_000:
                        held[rid] = [core(pd.concat(have), k)]
        for rid, _, _, k in requests:
            if rid in held:
                yield core(pd.concat(held[rid]), k).assign(request_id=rid, part=part)[["request_id", "part", "key", "phase", "struct_type", "vec"]]

    return run


def asked(rows: DataFrame) -> list[tuple]:
    """(request, phase, struct type, size): a small table by nature, read behind a check of its size."""
    norm = lambda c: F.replace(category(c), F.lit(" "), F.lit("_")).alias(c)
    got = rows.select("request_id", norm("phase"), norm("struct_type"), "subset_size").where("subset_size > 0 and request_id is not null").distinct().limit(MOST_REQUESTS + 1).collect()
    if len(got) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} subset requests")
    if any(r["subset_size"] > LIMIT for r in got) or sum(r["subset_size"] for r in got) > MOST_SELECTED:
        raise ValueError(f"a subset of more than {LIMIT} or subsets of more than {MOST_SELECTED} rows in all")
    return sorted((tuple(r) for r in got), key=lambda r: (r[0], str(r)))


def _final(sizes: dict[int, int]):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        k = sizes[int(f["request_id"].iloc[0])]
        f = f.drop_duplicates("key").sort_values("key", ignore_index=True)
        start = list(range(len(f)))
        if len(f) > k:
            p = Points(f)
            start, least = farthest(p, k)
            start = swaps(p, start, max(least / 2, NEAR), passes=50)
        got = f.iloc[start].reset_index(drop=True)
        mean, least = Points(got).among()
        return got[["request_id", "key", "phase", "struct_type"]].assign(mean_distance=mean, least_distance=least, vec=got["vec"])

    return run


def candidates(structures: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(key, phase, struct_type, vec): what can be selected."""
    return current(structures).select("key", "phase", "struct_type").join(vectors(descriptors), "key")


def subsets(rows: DataFrame, requests: list[tuple]) -> DataFrame:
    """(request_id, key, phase, struct_type, mean_distance, least_distance, vec): the subset of every request."""
    sizes = {r[0]: r[3] for r in requests}
    held = materialise(rows.mapInPandas(_cores(requests), ROW), "cores")
    while requests:
        most = held.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts")).where((F.col("n") > LIMIT) & (F.col("parts") > 1))
        if most.isEmpty():
            break
        merge = lambda f: core(f, sizes[int(f["request_id"].iloc[0])])[[*f.columns]]
        held = materialise(held.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("request_id", "part").applyInPandas(merge, ROW), "cores")
    return held.groupBy("request_id").applyInPandas(_final(sizes), "request_id int, key string, phase string, struct_type string, mean_distance double, least_distance double, vec binary")


def represented(rows: DataFrame, requests: list[tuple], chosen: DataFrame) -> DataFrame:
    """(request_id, key, representative, distance, selected): every candidate of a request with its nearest selected structure.

    ``chosen`` is what ``subsets`` gave, at most MOST_SELECTED rows by the check of the requests. Ties go to the smaller key.
    """
    held: dict[int, list] = {}
    for r in chosen.select("request_id", "key", "phase", "struct_type", "vec").collect():
        held.setdefault(r["request_id"], []).append((r["key"], r["phase"] or "", r["struct_type"] or "", bytes(r["vec"])))
    sides = {}
    for rid, got in held.items():
        got.sort()
        codes = [{v: i for i, v in enumerate(sorted({g[c] for g in got}))} for c in (1, 2)]
        x = np.frombuffer(b"".join(g[3] for g in got), "<f4").reshape(len(got), -1)
        sides[rid] = (np.array([g[0] for g in got], object), x, codes, [np.array([code[g[c]] for g in got]) for c, code in zip((1, 2), codes, strict=True)])
    sides_b = rows.sparkSession.sparkContext.broadcast(sides)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            y = normalised(np.frombuffer(b"".join(f["vec"]), "<f4").reshape(len(f), -1))
            for rid, phase, kind, _ in requests:
                if rid not in sides_b.value:
                    continue
                fits = (f["phase"].eq(phase) if phase is not None else pd.Series(True, f.index)) & (f["struct_type"].eq(kind) if kind is not None else pd.Series(True, f.index))
                at = np.flatnonzero(fits.to_numpy(bool))
                keys, x, codes, labels = sides_b.value[rid]
                own = [f[c].fillna("").map(code).fillna(-1).to_numpy(int) for c, code in zip(("phase", "struct_type"), codes, strict=True)]
                for s in range(0, len(at), 1_024):
                    i = at[s : s + 1_024]
                    d = np.sqrt(np.maximum(2 - 2 * (y[i] @ x.T), 0)) + sum(BONUS * (o[i, None] != lab[None]) for o, lab in zip(own, labels, strict=True))
                    mine = keys[None] == f["key"].to_numpy()[i, None]
                    d[mine] = -1  # a selected structure stands for itself
                    best = d.argmin(1)
                    yield pd.DataFrame({"request_id": rid, "key": f["key"].to_numpy()[i], "representative": keys[best], "distance": np.maximum(d[np.arange(len(i)), best], 0).astype(float), "selected": mine.any(1)})

    return rows.mapInPandas(run, "request_id int, key string, representative string, distance double, selected boolean")


def subset_report(rows: DataFrame, requests: list[tuple], chosen: DataFrame) -> DataFrame:
    """Per request: what was asked and there, and the variety of what was selected."""
    spark = rows.sparkSession
    want = spark.createDataFrame(requests, "request_id int, p string, t string, subset_size long")
    counts = rows.groupBy("phase", "struct_type").agg(F.count(F.lit(1)).alias("n"))
    there = F.broadcast(want).join(counts, (F.col("p").isNull() | (F.col("p") == F.col("phase"))) & (F.col("t").isNull() | (F.col("t") == F.col("struct_type"))), "left")
    there = there.groupBy("request_id", "p", "t", "subset_size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_available"), F.countDistinct("phase").alias("phases_available"), F.countDistinct("struct_type").alias("types_available"))
    got = chosen.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_selected"), F.countDistinct("phase").alias("phases_selected"), F.countDistinct("struct_type").alias("types_selected"), F.round(F.avg("mean_distance"), 4).alias("mean_distance"), F.round(F.min("least_distance"), 4).alias("least_distance"))
    return there.join(got, "request_id", "left").select("request_id", F.col("p").alias("phase"), F.col("t").alias("struct_type"), "subset_size", "n_available", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "phases_available", "phases_selected", "types_available", "types_selected", "mean_distance", "least_distance")
