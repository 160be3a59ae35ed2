"""Most similar vectors for every vector, by additive quantisation.

Index: a coarse codebook (cells) and LEVELS full-dimensional residual codebooks of WORDS words,
fitted on a bounded sample of ``SAMPLE`` distinct vectors; every vector is indexed. A vector is
encoded by a beam search of width BEAM over the levels (the best sum of words, not the greedily
best word of each level) and stores with its codes the norms the scoring needs.

Search: each vector looks into its PROBES nearest cells. There a table of its products with all
words is built once, and the product with a stored vector is the sum of LEVELS + 1 looked-up
numbers. With a least similarity s the pruning is lossless: for unit vectors q, x with q.x >= s the
looked-up product q.y with the decoded y is at least s (x.y) - sqrt(1 - s^2) |y - (x.y) x|, and
this bound is stored with x. Survivors are reranked by their exact cosine. Without a least
similarity the RERANK best-scored of each cell are reranked. A pair found from either side counts
for both. So the only loss comes from cells that neither side looks into; it is measured against
brute force in the tests and in the README.

Traffic: cells that lie near each other form groups of bounded expected size, and a vector is sent
once to each group that it looks into, with the numbers of the cells there; in its own group its
stored row asks. So it is not sent once a cell.

Skew: vectors of equal content are one class from the start (a hot group of copies is searched
once). Beyond COUNT vectors, or where a group is expected to hold or to be asked by too many, groups are
counted and those too large for one task are cut into blocks on both sides, all of which meet; so no
cut loses a pair, and recall does not hang on it.

The number of cells grows with the root of the number of vectors, up to a quarter of the sample
(SAMPLE, LARGE_SAMPLE beyond COUNT vectors); beyond that cells grow and every vector of a probed cell is
still scored, so that recall does not fall.

Defined results: vectors that are null, of another length, with null or non-finite numbers or all
zero take no part; an id with several vectors counts by its earliest row; equal similarities are
ranked by id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.ids import id_key
from latticework.session import materialise

DIM = 64
#: Vectors that the codebooks are fitted on; the larger number beyond COUNT vectors.
SAMPLE, LARGE_SAMPLE = 16_384, 65_536
COUNT = 1_000_000
LEVELS, WORDS, BEAM = 8, 32, 6
PROBES = 4
#: Cells for n vectors: this times the root of n, as a power of two.
CELLS = 4
#: Stored and asking vectors that one task's block holds.
BLOCK, QUERIES = 8_192, 131_072
#: Best-scored vectors of a cell that are reranked where no least similarity prunes.
RERANK = 48
#: Beyond the best k in single precision so many are ranked in double.
SPARE = 4
#: Expected stored vectors of a group of cells, for every EACH cells looked into.
GROUP, EACH = 1_200, 8
#: Products of vectors with cells or words that are held at once, whatever their numbers.
HELD = 4_000_000


def _scores(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, scores) of blocks of x: the larger the score with a row of c, the nearer it is."""
    half, step = 0.5 * (c * c).sum(1), max(1, HELD // max(len(c), 1))
    for s in range(0, len(x), step):
        yield slice(s, s + step), x[s : s + step] @ c.T - half


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    near = np.empty(len(x), np.int64)
    for rows, score in _scores(x, c):
        near[rows] = np.argmax(score, 1)
    return near


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(c) < k:
        c = np.concatenate([c, np.repeat(c[:1], k - len(c), 0) + rng.normal(0, 1e-3, (k - len(c), x.shape[1])).astype(np.float32)])
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        some = n > 0
        sums = np.add.reduceat(x[order], starts[some], axis=0)
        c[some] = sums / n[some, None]
        c[~some] = x[rng.choice(len(x), int((~some).sum()))]
    return c


@dataclass
class Index:
    """The fitted codebooks: cells (C x DIM), words (LEVELS x WORDS x DIM), and the group of each cell."""

    cells: np.ndarray
    words: np.ndarray
    group: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n_cells: int, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        cells = _kmeans(x, n_cells, 8, rng)
        rest = x - cells[cls._nearest(x, cells)]
        words = np.zeros((LEVELS, WORDS, x.shape[1]), np.float32)
        for m in range(LEVELS):
            words[m] = _kmeans(rest, WORDS, 8, rng)
            rest = rest - words[m][cls._nearest(rest, words[m])]
        return cls(cells, words, np.arange(len(cells)))

    def join(self, expected: np.ndarray, most: float, together: int = 16, seed: int = 7) -> None:
        """Put cells that lie near each other, about ``together``, into groups of at most ``most`` expected vectors (or one cell)."""
        near = _kmeans(self.cells, max(1, len(self.cells) // together), 8, np.random.default_rng(seed))
        home = self._nearest(self.cells, near)
        held, group = {}, -1
        for c in np.lexsort((np.arange(len(home)), home)):
            if not held or held["home"] != home[c] or held["n"] + expected[c] > most:
                group, held = group + 1, {"home": home[c], "n": 0.0}
            held["n"] += expected[c]
            self.group[c] = group

    _nearest = staticmethod(_nearest)

    def probe(self, x: np.ndarray, p: int) -> np.ndarray:
        """The p nearest cells (n x p), the nearest first."""
        p = min(p, len(self.cells))
        near = np.empty((len(x), p), np.int64)
        for rows, score in _scores(x, self.cells):
            np.negative(score, out=score)
            best = np.argpartition(score, p - 1, axis=1)[:, :p]
            near[rows] = np.take_along_axis(best, np.argsort(np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        return near

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Beam search: the codes (n x LEVELS) whose words best sum up to x less its cell."""
        rest = x - self.cells[cell]
        flat = self.words.reshape(LEVELS * WORDS, -1)
        dot, gram = rest @ flat.T, flat @ flat.T
        own = np.diag(gram)
        n = len(x)
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 rest.sum
        for m in range(LEVELS):
            s = slice(m * WORDS, (m + 1) * WORDS)
            products = np.ascontiguousarray(2 * gram[:, s])  # of every word with this level's words
            new = (own[s] - 2 * dot[:, s])[:, None] + cost[:, :, None]
            for j in range(m):
                new += products[j * WORDS + codes[:, :, j]]
            flatnew = new.reshape(n, -1)
            b = min(BEAM, flatnew.shape[1]) if m < LEVELS - 1 else 1
            best = np.argpartition(flatnew, b - 1, axis=1)[:, :b]
            cost = np.take_along_axis(flatnew, best, 1)
            beam, word = best // WORDS, best % WORDS
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None]], 2)
        return codes[:, 0]

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        y = self.cells[cell].copy()
        for m in range(LEVELS):
            y += self.words[m][codes[:, m]]
        return y

    def stored(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(norm of the decoded vector, least looked-up product of a vector at least ``least`` similar)."""
        y = self.decode(cell, codes)
        norm = np.sqrt((y * y).sum(1))
        if least is None:
            return norm, np.zeros(len(x), np.float32)
        xy = (x * y).sum(1)
        across = np.sqrt(np.maximum(norm * norm - xy * xy, 0))
        return norm, np.where(xy > 0, least * xy, xy) - math.sqrt(1 - least * least) * across - 1e-5


def _unpack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f4").reshape(len(col), -1)


def _unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, descriptors) -> (key, vec): the raw numbers as bytes."""
    for f in frames:
        v = np.asarray(f["descriptors"].tolist(), "<f4").reshape(len(f), -1) + np.float32(0)
        yield pd.DataFrame({"key": f["key"], "vec": [r.tobytes() for r in v]})


def normalised(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # a norm may over- or underflow
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(key, vec): one usable vector per id."""
    fine = F.forall("descriptors", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("descriptors", lambda v: v != 0)
    good = rows.select(id_key("atl_id").alias("key"), F.col("descriptors").cast("array<float>").alias("descriptors"), F.col("recorded_at").alias("at"))
    good = good.where("key is not null").where(F.size("descriptors") == dim).where(fine)
    one = good.groupBy("key").agg(F.min(F.struct("at", "descriptors")).alias("f")).select("key", "f.descriptors")
    return one.mapInPandas(_unit, "key string, vec binary")


ROW = "role boolean, cls long, cell long, bucket long, vec binary, codes binary, norm float, floor float, looks binary"


def _assign(index, least: float | None, probes: int) -> Callable:
    """(cls, vec) -> a stored row (cell, codes, norms) and one asking row for each further group looked into.

    ``looks``: the cells of the row's group that it looks into.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for f in frames:
            for s in range(0, len(f), 2_048):
                g = f.iloc[s : s + 2_048]
                x = normalised(_unpack(g["vec"]))
                near = ix.probe(x, probes)
                own = near[:, 0]
                codes = ix.encode(x, own)
                norm, floor = ix.stored(x, own, codes, least)
                cls, vec = g["cls"].to_numpy(), np.array([r.tobytes() for r in x], object)
                group = ix.group[near]
                order = np.argsort(group, axis=1, kind="stable")
                group, near = np.take_along_axis(group, order, 1), np.take_along_axis(near, order, 1).astype("<i4")
                first = np.ones(group.shape, bool)
                first[:, 1:] = group[:, 1:] != group[:, :-1]
                row, start = np.nonzero(first)
                end = np.append(start[1:], 0)
                end[end == 0] = group.shape[1]  # the next run of the row, or its end
                looks = np.array([near[r, a:b].tobytes() for r, a, b in zip(row, start, end, strict=True)], object)
                at = group[row, start]
                mine = at == ix.group[own][row]
                yield pd.DataFrame({"role": False, "cls": cls[row[mine]], "cell": own, "bucket": at[mine], "vec": vec[row[mine]], "codes": [c.tobytes() for c in codes.astype(np.uint8)], "norm": norm, "floor": floor, "looks": looks[mine]})
                yield pd.DataFrame({"role": True, "cls": cls[row[~mine]], "cell": -1, "bucket": at[~mine], "vec": vec[row[~mine]], "codes": None, "norm": 0.0, "floor": 0.0, "looks": looks[~mine]})

    return run


def _search(index, least: float | None, k: int) -> Callable:
    """All stored vectors of a group and all that look into it -> (a, b, similarity): for each that looks, its k best, with a least similarity of each cell.

    The stored vectors look too, unless the group was cut; then they come as rows of their own.
    """
    none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64), "sim": np.array([], float)})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        role = g["role"].to_numpy(bool)
        base, ask = g[~role], g[role] if g["cut"].iloc[0] else g
        if not len(base) or not len(ask):
            return none
        seen = np.frombuffer(b"".join(ask["looks"]), "<i4")
        owner = np.repeat(np.arange(len(ask)), [len(b) // 4 for b in ask["looks"]])
        order = np.argsort(seen, kind="stable")
        seen, owner = seen[order], owner[order]
        q, who = _unpack(ask["vec"]), ask["cls"].to_numpy()
        x, ids = _unpack(base["vec"]), base["cls"].to_numpy()
        codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), LEVELS)
        norm, floor, cell = base["norm"].to_numpy(np.float32), base["floor"].to_numpy(np.float32), base["cell"].to_numpy()
        out = [none]
        for c in np.unique(cell):
            rows = owner[np.searchsorted(seen, c) : np.searchsorted(seen, c, side="right")]
            if len(rows):
                at = np.flatnonzero(cell == c)
                out += one(index.value, c, q, who, rows, x[at], ids[at], codes[at], norm[at], floor[at])
        if least is not None:  # few: the best of each cell, which may count for the other side
            return pd.concat(out, ignore_index=True)
        a, b, sim = (np.concatenate([o[n].to_numpy() for o in out]) for n in ("a", "b", "sim"))
        keep = best(a, b, sim)
        return pd.DataFrame({"a": a[keep], "b": b[keep], "sim": sim[keep]})

    def best(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Places of the k best of each a."""
        order = np.lexsort((b, -sim, a))
        a = a[order]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        pos = np.arange(len(a))
        return order[pos - np.maximum.accumulate(np.where(first, pos, 0)) < k]

    def rerank(x: np.ndarray, y: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) places of the best k and a few more of each query's candidates b, in single precision."""
        sim = np.empty(b.shape, np.float32)
        step = max(1, 60_000 // len(b))
        for t in range(0, b.shape[1], step):
            u = slice(t, t + step)
            sim[:, u] = np.einsum("rqd,qd->rq", x[b[:, u]], y[u])
        sim[own] = -2
        top = np.argpartition(-sim, min(k + SPARE, len(b)) - 1, axis=0)[: k + SPARE]
        return np.tile(np.arange(b.shape[1]), len(top)), np.take_along_axis(b, top, 0).ravel()

    def one(ix: Index, c: int, q, who, rows, x, ids, codes, norm, floor) -> list[pd.DataFrame]:
        flat = ix.words.reshape(LEVELS * WORDS, -1)
        out, step = [], max(16, 4_000_000 // len(x))
        for s in range(0, len(rows), step):
            y, name = q[rows[s : s + step]], who[rows[s : s + step]]
            lut = flat @ y.T  # (words of all levels) x queries: a word's products lie together
            score = np.repeat((ix.cells[c] @ y.T)[None], len(x), axis=0)
            for m in range(LEVELS):
                score += lut[m * WORDS + codes[:, m]]
            if least is not None:
                b, a = np.nonzero(score >= floor[:, None])
            else:
                score /= norm[:, None]
                b = np.argpartition(-score, min(RERANK, len(x)) - 1, axis=0)[:RERANK]
                a, b = rerank(x, y, b, ids[b] == name)
            other = ids[b] != name[a]
            a, b = a[other], b[other]
            if least is not None:  # in single precision first, with room for its error
                near = [np.einsum("ij,ij->i", y[a[t : t + 100_000]], x[b[t : t + 100_000]]) >= least - 1e-4 for t in range(0, len(a), 100_000)]
                keep = np.concatenate([np.zeros(0, bool), *near])
                a, b = a[keep], b[keep]
            sim = np.empty(len(a))
            for t in range(0, len(a), 100_000):
                u = slice(t, t + 100_000)
                sim[u] = np.einsum("ij,ij->i", y[a[u]].astype(np.float64), x[b[u]].astype(np.float64))
            if least is not None:
                keep = sim >= least
                a, b, sim = a[keep], b[keep], sim[keep]
            top = best(name[a], ids[b], sim)
            out.append(pd.DataFrame({"a": name[a[top]], "b": ids[b[top]], "sim": sim[top]}))
        return out

    return run


def _blocks(both: DataFrame) -> DataFrame:
    """A ``part`` for each row; groups too large for one task are cut on both sides, and every block meets every other.

    ``both`` is made twice, once to be counted: stored, it would be several times the vectors.
    """
    counts = both.groupBy("bucket").agg(F.sum((~F.col("role")).cast("long")).alias("n"), F.count(F.lit(1)).alias("m"))
    large = counts.where((F.col("n") > BLOCK) | (F.col("m") > QUERIES))
    large = large.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / QUERIES).cast("int").alias("mb"))
    large = materialise(large, "large")
    if large.isEmpty():
        return _whole(both)
    cut = both.join(F.broadcast(large), "bucket", "left").withColumn("cut", F.col("nb").isNotNull() & (F.col("nb") > 0)).withColumn("known", F.col("nb").isNotNull()).fillna(1, ["nb", "mb"])  # groups are no more than cells
    cut = cut.withColumn("role", F.explode(F.expr("if(role or not known, array(role), array(false, true))"))).withColumn("nb", F.greatest("nb", F.lit(1)))
    own = F.expr("pmod(hash(cls), if(role, mb, nb))")
    parts = F.expr("if(role, transform(sequence(0, nb - 1), i -> i * mb + own), transform(sequence(0, mb - 1), j -> own * mb + j))")
    return cut.withColumn("own", own).withColumn("part", F.explode(parts)).drop("own", "nb", "mb", "known")


def _whole(both: DataFrame) -> DataFrame:
    return both.withColumn("part", F.lit(0)).withColumn("cut", F.lit(False))


def class_edges(classes: DataFrame, k: int, least: float | None, probes: int = PROBES, sample: int | None = None, cells: int | None = None) -> DataFrame:
    """(a, b, sim): for each class its best others, found from either side. ``classes`` (cls long, vec) must be a stored table."""
    spark = classes.sparkSession
    n = classes.count()
    sample = sample or (SAMPLE if n <= COUNT else LARGE_SAMPLE)
    share = min(1.0, (sample + 8 * math.sqrt(sample)) / max(n, 1))
    mark = F.xxhash64(F.lit(1), "cls")
    rows = classes.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    taken = rows.orderBy(mark).select("vec").limit(sample).collect()
    if not taken:
        return spark.createDataFrame([], "a long, b long, sim double")
    x = normalised(np.frombuffer(b"".join(bytes(r[0]) for r in taken), "<f4").reshape(len(taken), -1))
    del taken
    n_cells = cells or 2 ** max(0, round(math.log2(max(CELLS * math.sqrt(n), 1))))
    index = Index.fit(x, min(n_cells, max(1, len(x) // 4)))
    # expected stored and asking rows, from the sample
    near = index.probe(x, probes)
    held = np.bincount(near[:, 0], minlength=len(index.cells)) * (n / len(x))
    index.join(held, GROUP * -(-probes // EACH))
    groups = int(index.group.max()) + 1
    into = np.sort(index.group[near], axis=1)  # a row is sent once a group, however many cells of it are looked into
    into = into[np.concatenate([np.ones((len(x), 1), bool), into[:, 1:] != into[:, :-1]], axis=1)]
    asked = np.bincount(into, minlength=groups) * (n / len(x))
    index_b = spark.sparkContext.broadcast(index)
    both = classes.mapInPandas(_assign(index_b, least, probes), ROW)
    if n > COUNT or np.bincount(index.group, held).max() > BLOCK // 2 or asked.max() > QUERIES // 2:
        cut = _blocks(both)
    else:
        cut = _whole(both)
    # stated: the work is not in the bytes
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 4))
    found = cut.repartition(tasks, "bucket", "part").groupBy("bucket", "part").applyInPandas(_search(index_b, least, k), "a long, b long, sim double")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _name(seed: int):
    return F.xxhash64(F.lit(seed), "vec")


def _classes(held: DataFrame, name: Callable = _name) -> tuple[DataFrame, DataFrame]:
    """(key, vec, cls) and (cls, vec, m): equal vectors are one class.

    A class is named by a 64-bit hash, which for 1e6 vectors collides once in 1e8 collections; then another seed is taken.
    """
    for seed in range(8):
        named = held.withColumn("cls", name(seed))
        sizes = materialise(named.groupBy("cls").agg(F.min("vec").alias("vec"), (F.min("vec") != F.max("vec")).alias("clash"), F.count(F.lit(1)).alias("m")), "classes")
        if sizes.where("clash").isEmpty():
            return named, sizes
    raise ValueError("too many vectors for hashes of 64 bits")


def nearest(rows: DataFrame, k: int = 5, least: float | None = None, probes: int = PROBES) -> DataFrame:
    """(key, other, sim, rank): for each id its k most similar other ids, if at least ``least`` similar."""
    held, sizes = _classes(materialise(vectors(rows), "vectors"))
    # by a once: pairs found from both sides become one, and of each class's others only those that can be among its k best go on
    edges = class_edges(sizes.select("cls", "vec"), k, least, probes).repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    edges = edges.withColumn("nth", F.rank().over(Window.partitionBy("a").orderBy(F.desc("sim")))).where(F.col("nth") <= k).drop("nth")
    ids = held.select("cls", "key")
    firsts = ids.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("key"))).where(F.col("nth") <= k + 1)
    firsts = materialise(firsts.join(sizes.select("cls", "m"), "cls"), "firsts")
    far = edges.join(firsts.select(F.col("cls").alias("b"), F.col("key").alias("other")), "b")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "other"))).where(F.col("rank") <= k)
    far = far.join(firsts.where(F.col("m") <= k).select(F.col("cls").alias("a"), "key", "m"), "a").withColumn("rank", (F.col("rank") + F.col("m") - 1).cast("int")).where(F.col("rank") <= k)
    same = ids.join(firsts.where("m > 1").select("cls", F.col("key").alias("other"), "nth"), "cls").where("key != other")
    same = same.withColumn("rank", F.when(F.col("other") < F.col("key"), F.col("nth")).otherwise(F.col("nth") - 1).cast("int")).where(F.col("rank") <= k)
    return far.select("key", "other", "sim", "rank").unionByName(same.select("key", "other", F.lit(1.0).alias("sim"), "rank"))
