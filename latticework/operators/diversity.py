"""Diversity of a set of vectors: Vendi scores, circles, farthest points.

The linear Vendi score needs only the d x d second moments, which one aggregation gives for any
number of rows. The kernel version is defined on a subsample of stated size: it runs in one task on
at most LIMIT rows and refuses more. Greedy packings are sequential by definition: they go by rounds
of at most LIMIT rows in one task, for any number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.selection import draw

LIMIT = 20_000


def entropy_score(eigenvalues: np.ndarray) -> float:
    """exp of the entropy of the eigenvalues, taken as shares."""
    p = np.asarray(eigenvalues, float)
    p = p[p > 1e-12]
    p = p / p.sum() if len(p) else p
    return float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0


def vendi_linear(df: DataFrame, vector: str, dim: int) -> float:
    """Linear-kernel Vendi score of the rows scaled to length one, from their second moments."""

    def moments(frames):
        total, n = np.zeros((dim, dim)), 0
        for f in frames:
            x = np.array([v for v in f[vector] if v is not None and len(v) == dim], float).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = x[size[:, 0] > 0] / size[size[:, 0] > 0]
            total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"pos": range(dim * dim + 1), "v": [*total.ravel(), float(n)]})

    got = df.select(vector).mapInPandas(moments, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(dim * dim + 1)
    for r in got:  # dim^2 + 1 numbers
        flat[r["pos"]] = r["v"]
    return entropy_score(np.linalg.eigvalsh(flat[:-1].reshape(dim, dim) / flat[-1])) if flat[-1] else 0.0


def vendi_rbf(x: np.ndarray, sigma: float | None = None) -> float:
    """Kernel Vendi score; without sigma it is the mean distance to the nearest other row (one if that is zero)."""
    x = np.asarray(x, float)
    if not len(x):
        return 0.0
    if x.shape[1] == 2 and len(x) > PLANE:
        score = _vendi_plane(x, sigma)
        if score is not None:
            return score
    sq = (x * x).sum(1)
    d2 = x @ x.T  # in place from here: at 10,000 rows one copy is 800 MB
    d2 *= -2
    d2 += sq[:, None]
    d2 += sq
    np.maximum(d2, 0, out=d2)
    if sigma is None:
        np.fill_diagonal(d2, np.inf)
        sigma = float(np.sqrt(d2.min(1)).mean()) if len(x) > 1 else 1.0
        sigma = sigma or 1.0
    np.fill_diagonal(d2, 0)
    d2 /= -2 * sigma * sigma
    np.exp(d2, out=d2)
    d2 /= len(x)
    return entropy_score(np.linalg.eigvalsh(d2))


#: Points of a plane beyond which a band is tried. Kernel values below FAINT are below what rounding does to the eigenvalues.
PLANE, FAINT, BAND = 1_500, 1e-14, 128


def _vendi_plane(x: np.ndarray, sigma: float | None = None) -> float | None:
    """The score of ``vendi_rbf`` for points of a plane without eigenvalues; None where a band is no cheaper or rounding forbids it.

    Points further apart than the kernel reaches do not meet, so by order along an axis it is a band, and the determinant of
    t + P (P the kernel over n, of trace one) takes one pass. The entropy of P's eigenvalues is the integral over t > 0 of
    log det(1 + P/t) - log(1 + 1/t); over log t the trapezoid rule converges to rounding in about 60 terms.
    """
    if sigma is None:
        from latticework.operators import hulls

        sigma = hulls.nearest_distance(x) or 1.0
    n, reach = len(x), sigma * math.sqrt(-2 * math.log(FAINT))
    starts = np.arange(0, n, BAND)
    orders = [x[np.argsort(x[:, k], kind="stable")] for k in (0, 1)]
    ends = [np.searchsorted(o[:, k], o[np.minimum(starts + BAND, n) - 1, k] + reach, side="right") for k, o in enumerate(orders)]
    costs = [float(((e - starts).astype(float) ** 2).sum()) * BAND for e in ends]
    k = int(np.argmin(costs))
    if not np.isfinite(x).all() or costs[k] * 60 > 2 * float(n) ** 3:  # two operations each; eigenvalues take 4/3 n^3 slower ones
        return None
    x, end = orders[k], ends[k]

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2
        d2 /= -2 * sigma * sigma
        return np.exp(d2, out=d2) / n

    panels = [kernel(x[a:e], x[a : a + BAND]) for a, e in zip(starts, end, strict=True)]
    squares = sum(2 * float((p * p).sum()) - float((p[: p.shape[1]] ** 2).sum()) for p in panels)

    def log_det(t: float) -> float:
        """Of 1 + P/t, by Cholesky: ``due`` is what the columns so far take from those that they reach."""
        total, due = 0.0, np.zeros((0, 0))
        for p in panels:
            m = p.shape[1]
            at = p / t
            at.flat[: m * m : m + 1] += 1
            at[: len(due), : len(due)] -= due[:, :m]
            low = np.linalg.cholesky(at[:m])
            total += 2 * float(np.log(np.diagonal(low)).sum())
            y = at[m:] @ np.linalg.inv(low).T
            rest, due = due[m:, m:], y @ y.T
            due[: len(rest), : len(rest)] += rest
        return total

    h, low, high = 0.65, math.log(1e-15), math.log(1e3)
    try:
        entropy = sum(t * (log_det(t) - math.log1p(1 / t)) for t in map(math.exp, np.arange(low, high, h)))
    except np.linalg.LinAlgError:
        return None
    far = np.exp(np.arange(low + h * math.ceil((high - low) / h), 40, h))  # beyond, by the first terms of the series
    entropy += float(((1 - squares) / (2 * far) - (1 - squares**2) / (3 * far**2)).sum())
    return float(np.exp(h * entropy))


def vendi_subsampled(df: DataFrame, ident: str, vector: str, size: int = 10_000, rounds: int = 4, sigma: float | None = 0.1624) -> DataFrame:
    """(round, n, score): one task per seeded subsample of ``size`` rows; all rows if there are fewer."""
    if size > LIMIT:
        raise ValueError(f"a subsample of {size} rows does not fit one task ({LIMIT})")
    n = df.count()
    share = min(1.0, (size + 6 * math.sqrt(size) + 16) / max(n, 1))  # six deviations above the size
    each = df.select(ident, vector, F.explode(F.array(*[F.lit(i) for i in range(rounds)])).alias("round")).withColumn("k", F.md5(F.concat_ws(":", F.col("round").cast("string"), F.col(ident).cast("string"))))
    each = each.where(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") < share * (1 << 32))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k").head(size)
        x = np.array(f[vector].tolist(), float)
        return pd.DataFrame({"round": [f["round"].iloc[0]], "n": [len(x)], "score": [vendi_rbf(x, sigma)]})

    return each.groupBy("round").applyInPandas(one, "round int, n long, score double")


#: Rows that one pass of the farthest-point selection hands to the driver.
CANDIDATES = 2_048


def farthest(df: DataFrame, ident: str, vector: str, n: int, start: np.ndarray | None = None, most: int = CANDIDATES) -> DataFrame:
    """(ident, rank, distance): n rows, each the farthest from those before (and from ``start``); ties go to the smaller id.

    A pass gives the ``most`` rows that are farthest from what is selected. A row's distance to the selected only falls, so the
    best of these is the best of all while it exceeds the least that came; only then another pass is made. The selection is that of
    one pass a row. Rows without a vector or of another length than the first take no part; the first distance is infinite without ``start``.
    """
    spark = df.sparkSession
    kind, form = dict(df.dtypes)[ident], dict(df.dtypes)[vector]
    first = df.where(F.col(vector).isNotNull()).orderBy(ident).select(ident, vector).limit(1).collect()
    held = [np.asarray(v, float) for v in (start if start is not None else [])]
    out: list[tuple] = []
    if first and not held and n > 0:
        out.append((first[0][ident], 0, math.inf))
        held.append(np.asarray(first[0][vector], float))
    rows = df.where(F.size(vector) == len(first[0][vector])).select(ident, vector) if first else df.limit(0)
    taken = {o[0] for o in out}
    while first and len(out) < n:
        chosen = spark.sparkContext.broadcast(np.array(held))

        def near(frames, chosen=chosen):
            y = chosen.value
            for f in frames:
                x = np.array(f[vector].tolist(), float).reshape(len(f), -1)
                d = np.concatenate([np.sqrt(((x[s : s + 256, None] - y[None]) ** 2).sum(2)).min(1) for s in range(0, len(x), 256)]) if len(x) else np.zeros(0)
                f = f.assign(near=d)
                yield f.sort_values(["near", ident], ascending=[False, True], kind="stable").head(most)

        got = rows.mapInPandas(near, f"{ident} {kind}, {vector} {form}, near double").orderBy(F.desc("near"), ident).limit(most).collect()
        whole, bound = len(got) < most, got[-1]["near"] if got else 0.0
        got = [r for r in got if r[ident] not in taken]
        if not got:
            break
        ids, x, d = [r[ident] for r in got], np.array([r[vector] for r in got], float), np.array([r["near"] for r in got])
        began = len(out)
        while len(out) < n:
            best = float(d.max())
            if best <= 0 or (not whole and best <= bound and len(out) > began):
                break
            i = min(np.flatnonzero(d == best), key=lambda i: ids[i])
            out.append((ids[i], len(out), best))
            held.append(x[i])
            taken.add(ids[i])
            d = np.minimum(d, np.sqrt(((x - x[i]) ** 2).sum(1)))
            d[i] = -1.0
        if len(out) == began:
            break
    return spark.createDataFrame(out, f"{ident} {kind}, rank int, distance double")


def _unit_rows(vectors) -> np.ndarray:
    x = np.array(list(vectors), float).reshape(len(vectors), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def circles(df: DataFrame, ident: str, vector: str, threshold: float, seed: int = 0, step: int = LIMIT) -> DataFrame:
    """(ident, rank): the greedy packing in seeded order; no two kept rows lie within the threshold (cosine distance) of each other.

    It is made in rounds: the next ``step`` undecided rows of the order are packed in one task, then every later row
    within the threshold of a kept one is dropped. So a row is decided when all earlier ones are, whatever the
    number of rows, splits and batches.
    """
    from latticework.session import materialise

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", kind="stable")
        x, kept = _unit_rows(f[vector]), []
        held = np.empty_like(x)
        for i in range(len(x)):
            if (1 - held[: len(kept)] @ x[i] > threshold).all():
                held[len(kept)] = x[i]
                kept.append(i)
        return f.iloc[kept].assign(rank=range(len(kept)))

    def outside(kept):
        def run(frames):
            y = kept.value
            for f in frames:
                for s in range(0, len(f), 1_000):
                    g = f.iloc[s : s + 1_000]
                    yield g[(1 - _unit_rows(g[vector]) @ y.T > threshold).all(1)]

        return run

    spark = df.sparkSession
    left = materialise(df.select(ident, vector, draw(seed, ident).alias("k")).where(F.col(vector).isNotNull()), "undecided")
    form, packed, n = left.schema, None, 0
    while packed is None or not left.isEmpty():
        cut = left.select("k").orderBy("k").limit(step).agg(F.max("k")).first()[0]  # rows of one key stay together
        some = left.where(F.col("k") <= cut) if cut is not None else left
        kept = materialise(some.groupBy().applyInPandas(greedy, f"{ident} {dict(df.dtypes)[ident]}, {vector} {dict(df.dtypes)[vector]}, k string, rank int"), "circles")
        out = kept.select(ident, (F.col("rank") + n).cast("int").alias("rank"))
        packed = out if packed is None else packed.unionByName(out)
        near = [r[0] for r in kept.select(vector).collect()]  # at most step rows
        n += len(near)
        rest = left.where(F.col("k") > cut) if cut is not None else left
        if rest.isEmpty():
            break
        left = materialise(rest.mapInPandas(outside(spark.sparkContext.broadcast(_unit_rows(near))), form), "undecided")
    return packed
