"""Structure filters that need atoms, cells or trajectories, and rules for stages and dimensions."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.atoms import pairs
from latticework.session import spread


def along(normal: tuple[float, float, float]) -> Column:
    """Height of an atom along a direction."""
    n = np.array(normal, float) / np.linalg.norm(normal)
    return sum((F.col(c) * float(k) for c, k in zip("xyz", n, strict=True)), F.lit(0.0))


def surface_normal(cell: list[list[float]], miller: tuple[int, int, int]) -> tuple[float, float, float]:
    """Unit normal of a lattice plane, from the reciprocal cell."""
    rec = np.linalg.inv(np.array(cell, float)).T
    v = np.array(miller, float) @ rec
    return tuple(float(x) for x in v / np.linalg.norm(v))


def layers(atoms: DataFrame, normal: tuple[float, float, float] = (0, 0, 1), same: float = 1e-3) -> DataFrame:
    """(id, thickness, max_gap, n_gaps, min_gap): of the atomic layers along a direction; gaps up to ``same`` are within a layer."""
    h = atoms.select("id", along(normal).alias("h"))
    g = h.withColumn("gap", F.col("h") - F.lag("h").over(Window.partitionBy("id").orderBy("h")))
    real = F.when(F.col("gap") > same, F.col("gap"))
    return g.groupBy("id").agg((F.max("h") - F.min("h")).alias("thickness"), F.max(real).alias("max_gap"), F.count(real).alias("n_gaps"), F.min(real).alias("min_gap"))


def layer_filters(per: DataFrame, most_gap: float, most_thickness: float, tolerance: float = 1e-3) -> DataFrame:
    """layer_distance, evaporation and duplicate_slabs of each structure; for surfaces only."""
    equal = (F.col("n_gaps") >= 2) & (F.abs(F.col("max_gap") - F.col("min_gap")) <= tolerance + 1e-5 * F.abs("min_gap"))
    return per.select("id", F.coalesce(F.col("max_gap") > most_gap, F.lit(False)).alias("layer_distance"), (F.col("thickness") > most_thickness).alias("evaporation"), equal.alias("duplicate_slabs"))


def fragments(atoms: DataFrame, radius: Column, multiplier: float = 1.1) -> DataFrame:
    """(id, n_fragments, largest_fraction): connected parts of each structure's bond graph.

    A bond graph lies within one structure, so a structure's atoms come together once and nothing else moves. Structures of
    equal size are solved together: the least atom reachable spreads over the bonds, by doubling.
    """
    one = atoms.select("id", F.struct("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"), radius.cast("double").alias("r")).alias("a"))
    held = one.groupBy("id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    cols = [F.col(f"a.{c}").alias(c) for c in ("x", "y", "z", "r")]

    def run(frames):
        for f in frames:
            sizes = f["x"].map(len)
            for n, g in f.groupby(sizes):
                step = max(1, 2_000_000 // (n * n))
                for s in range(0, len(g), step):
                    part = g.iloc[s : s + step]
                    p = np.stack([np.stack(part[c].to_numpy()) for c in ("x", "y", "z")], 2)
                    r = np.stack(part["r"].to_numpy())
                    d2 = ((p[:, :, None] - p[:, None]) ** 2).sum(3)
                    near = np.sqrt(d2) <= multiplier * (r[:, :, None] + r[:, None])
                    near |= np.eye(n, dtype=bool)
                    lab = np.broadcast_to(np.arange(n), (len(part), n)).copy()
                    while True:
                        new = np.where(near, lab[:, None, :], n).min(2)
                        new = np.take_along_axis(new, new, 1)
                        if (new == lab).all():
                            break
                        lab = new
                    count = np.zeros((len(part), n), int)
                    np.add.at(count, (np.arange(len(part))[:, None], lab), 1)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "n_fragments": (count > 0).sum(1), "largest_fraction": count.max(1) / n})

    return held.select("id", *cols).mapInPandas(run, f"id {dict(atoms.dtypes)['id']}, n_fragments long, largest_fraction double")


def fragmented(per: DataFrame, least_largest: float = 0.95, most: int | None = None) -> DataFrame:
    bad = F.col("largest_fraction") < least_largest
    return per.select("id", (bad | (F.col("n_fragments") > most) if most is not None else bad).alias("fragmented"))


def loose_bonds(coord: DataFrame, bonds: DataFrame, least: int = 3) -> DataFrame:
    """(id): structures in which an atom of fewer than ``least`` neighbours is bonded to one of fewer still."""
    a = coord.select("id", F.col("idx").alias("i"), F.col("coord").alias("ci"))
    b = coord.select("id", F.col("idx").alias("j"), F.col("coord").alias("cj"))
    return bonds.select("id", "i", "j").join(a, ["id", "i"]).join(b, ["id", "j"]).where((F.col("ci") < least) & (F.col("cj") < F.col("ci"))).select("id").distinct()


def exploding(energy: Column, temperatures: Column, forces: Column, velocities: Column, *, most_t: float, factor: float = 10.0, most_f: float = 25.0, most_v: float = 2.0, positive_energy: bool = False) -> Column:
    """The first sign of an explosion of a frame, or null: energy, temperature, force, velocity, in this order."""
    out = F.when(F.lit(positive_energy) & (energy > 0), "energy").when(F.exists(temperatures, lambda t: t > most_t * factor), "temperature")
    return out.when(F.exists(forces, lambda f: F.abs(f) > most_f), "force").when(F.exists(velocities, lambda v: F.abs(v) > most_v), "velocity")


def short_cell(lengths: Column, least: float) -> Column:
    return F.exists(lengths, lambda x: x < least)


def stage_allowed(spec: str | None, step: Column, kind: Column, kinds: list[str]) -> Column:
    """Whether a step lies in ranges such as ``1-3,5``; without ranges, whether the type is listed."""
    if not spec:
        return kind.isin(kinds)
    steps = [s for part in spec.split(",") for a, _, b in [part.strip().partition("-")] for s in range(int(a), int(b or a) + 1)]
    return step.isin(steps)


def without_setting(phases: DataFrame, have: dict[str, float], default: str = "ATL_DEFAULT") -> DataFrame:
    """The phases that neither have a setting of their own nor a default."""
    return phases.where(F.lit(False)) if default in have else phases.where(~F.col("phase").isin(list(have)))


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, or the second if the first has no rows."""
    return second if first.isEmpty() else first


def test_split(rows: DataFrame, share: float, isolated: Column, seed: int, *ids: str) -> DataFrame:
    """``part``: test for max(1, int(n * share)) rows at random, n - 1 at most; isolated atoms so drawn are in neither part."""
    from latticework.operators.selection import draw

    n = rows.count()
    k = min(max(1, int(n * share)), max(n - 1, 0))
    drawn = rows.select(*ids).orderBy(draw(seed, *ids), *ids).limit(k).withColumn("_t", F.lit(True))
    part = F.when(F.col("_t") & isolated, "neither").when(F.col("_t"), "test").otherwise("train")
    return rows.join(drawn, list(ids), "left").withColumn("part", part).drop("_t")


def select(df: DataFrame, how: str, n: int, **given) -> DataFrame:
    """n rows by a named strategy: random, lowest_energy, uncertainty (the largest of a column) or fps."""
    from latticework.operators import diversity, selection

    if how == "random":
        return selection.sample(df, n, given.get("seed", 0), given["ident"])
    if how == "lowest_energy":
        return selection.lowest(df, given["energy"], n, given["ident"])
    if how == "uncertainty":
        return df.orderBy(F.desc_nulls_last(given["uncertainty"]), given["ident"]).limit(n)
    if how == "fps":
        start = given.get("start")
        return df.join(diversity.farthest(df, given["ident"], given["vector"], n, start).select(given["ident"]), given["ident"], "left_semi")
    raise ValueError(f"no strategy {how!r}; there are random, lowest_energy, uncertainty, fps")


#: Settings whose cheaper end is the larger value.
CHEAP_HIGH = ("kspacing", "sigma", "ediff")


def cheap_rank(param: Column, value: Column) -> Column:
    """A sort key that puts cheap values of a calculation setting first."""
    return F.when(F.lower(param).isin(*CHEAP_HIGH), -value).otherwise(value)


def resample(path: DataFrame, n: int, by: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(by, k, x, y): n points at even arc length along each polyline, by linear interpolation."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    run = path.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("_s").over(Window.partitionBy(*by))
    seg = run.withColumn("_total", total).withColumn("_s0", F.lag("_s").over(w)).withColumn("_x0", F.lag(x).over(w)).withColumn("_y0", F.lag(y).over(w)).where(F.col("_s0").isNotNull() & (F.col("_s") > F.col("_s0")))
    at = F.col("_total") * F.col("k") / max(n - 1, 1)
    last = F.col("_s") >= F.col("_total")
    low = F.greatest(F.ceil(F.col("_s0") * (n - 1) / F.col("_total") - 1e-9), F.lit(0)).cast("int")
    high = F.when(last, F.lit(n - 1)).otherwise(F.ceil(F.col("_s") * (n - 1) / F.col("_total") - 1e-9).cast("int") - 1)
    pts = seg.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    part = F.least(F.greatest((at - F.col("_s0")) / (F.col("_s") - F.col("_s0")), F.lit(0.0)), F.lit(1.0))
    return pts.select(*by, "k", (F.col("_x0") + (F.col(x) - F.col("_x0")) * part).alias(x), (F.col("_y0") + (F.col(y) - F.col("_y0")) * part).alias(y))


def average_kernel(df: DataFrame, ident: str, matrix: str, sigma: float) -> DataFrame:
    """(a, b, kernel): the normalised mean kernel between all atoms of two structures, for a small stated set of structures."""
    rows = df.limit(501).collect()
    if len(rows) > 500:
        raise ValueError("the kernel is for a stated set of at most 500 structures")
    mats = [np.array(r[matrix], float) for r in rows]

    def k(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * sigma * sigma)).mean())

    own = [k(m, m) for m in mats]
    out = [(rows[i][ident], rows[j][ident], float(k(mats[i], mats[j]) / np.sqrt(own[i] * own[j])) if own[i] > 0 and own[j] > 0 else 0.0) for i in range(len(rows)) for j in range(i, len(rows))]
    kind = dict(df.dtypes)[ident]
    return df.sparkSession.createDataFrame(out, f"a {kind}, b {kind}, kernel double")


def sphere(n: int, spacing: float, seed: int = 0) -> pd.DataFrame:
    """(idx, x, y, z): n atoms packed in a sphere, none closer than the spacing allows: the n lattice points nearest to a seeded centre."""
    side = int(np.ceil((3 * n / (16 * np.pi)) ** (1 / 3))) + 2  # four atoms a cubic cell
    a = spacing * np.sqrt(2)
    base = np.array([[0, 0, 0], [0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]])
    grid = np.array(np.meshgrid(*[np.arange(-side, side)] * 3)).reshape(3, -1).T
    pts = ((grid[:, None] + base[None]).reshape(-1, 3)) * a
    centre = np.random.default_rng(seed).uniform(-0.25, 0.25, 3) * a
    near = pts[np.argsort(((pts - centre) ** 2).sum(1), kind="stable")[:n]] - centre
    return pd.DataFrame({"idx": range(n), "x": near[:, 0], "y": near[:, 1], "z": near[:, 2]})


def wulff(n: int, spacing: float, energies: dict[tuple[int, int, int], float] | None = None) -> pd.DataFrame:
    """(idx, x, y, z): the n atoms of a face-centred cubic crystal that lie in the smallest Wulff shape holding them.

    ``energies`` gives the surface energy of plane families; an atom's rank is its largest height over a plane's energy. Ties by place.
    """
    energies = energies or {(1, 0, 0): 1.1, (1, 1, 0): 1.15, (1, 1, 1): 1.0}
    planes = [(np.array(p, float) / np.linalg.norm(p), e) for family, e in energies.items() for p in {tuple(s * v for s, v in zip(sign, perm, strict=True)) for perm in permutations(family) for sign in product((1, -1), repeat=3)}]
    side = int(np.ceil((n / 4) ** (1 / 3))) + 2
    a = spacing * np.sqrt(2)
    base = np.array([[0, 0, 0], [0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]])
    grid = np.array(np.meshgrid(*[np.arange(-side, side + 1)] * 3)).reshape(3, -1).T
    pts = (grid[:, None] + base[None]).reshape(-1, 3) * a
    rank = np.round(np.max([pts @ d / e for d, e in planes], axis=0), 9)
    near = pts[np.lexsort((pts[:, 2], pts[:, 1], pts[:, 0], (pts**2).sum(1).round(9), rank))[:n]]
    return pd.DataFrame({"idx": range(n), "x": near[:, 0], "y": near[:, 1], "z": near[:, 2]})


@lru_cache(maxsize=64)
def _wulff(n: int, spacing: float) -> pd.DataFrame:
    """A Wulff shape depends on its size alone; clusters up to this many sizes apart are built once a worker."""
    return wulff(n, spacing)


def cluster_arrays(requests: DataFrame, spacing: float, shape: str = "sphere") -> DataFrame:
    """(id, element, n, x, y, z) of one cluster per request (id, element, n), its atoms' places as arrays: a sphere or a Wulff shape."""

    def run(frames):
        for f in frames:
            if shape == "sphere":
                at = [sphere(int(n), spacing, int(i)) for i, n in zip(f["id"], f["n"], strict=True)]
            else:
                at = [_wulff(int(n), spacing) for n in f["n"]]
            yield f.assign(**{c: [p[c].to_numpy() for p in at] for c in "xyz"})

    work = spread(requests.select(F.col("id").cast("long").alias("id"), "element", F.col("n").cast("long").alias("n")))
    return work.mapInPandas(run, "id long, element string, n long, x array<double>, y array<double>, z array<double>")


def clusters(spark, requests: DataFrame, spacing: float, shape: str = "sphere") -> DataFrame:
    """(id, idx, element, x, y, z) of one cluster per request (id, element, n): a sphere or a Wulff shape."""
    atoms = cluster_arrays(requests, spacing, shape).select("id", "element", F.posexplode(F.arrays_zip("x", "y", "z")).alias("idx", "p"))
    return atoms.select("id", "idx", "element", "p.x", "p.y", "p.z")


def with_adsorbate(atoms: DataFrame, exposed_atoms: DataFrame, element: str, height: float, seed: int) -> DataFrame:
    """Each structure with one atom added above one of its exposed atoms, drawn at random."""
    from latticework.functions.seeded import uniform

    site = exposed_atoms.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(uniform(seed, "id", "idx"), "idx"))).where("_n = 1")
    last = atoms.groupBy("id").agg(F.max("idx").alias("_last"))
    new = site.join(last, "id").select("id", (F.col("_last") + 1).alias("idx"), F.lit(element).alias("element"), "x", "y", (F.col("z") + height).alias("z"))
    return atoms.select("id", "idx", "element", "x", "y", "z").unionByName(new)
