"""More generators and rules: slabs, dimers, distortions, element constants, features, penalties.

Per-structure numpy where lattice arithmetic needs it; always in Arrow batches, one structure at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import seeded

#: Lattice constant (Å), lattice, covalent radius (Å) and mass (u) of common elements.
ELEMENTS = {
    "Al": (4.05, "fcc", 1.21, 26.982), "Ti": (2.95, "hcp", 1.60, 47.867), "Cr": (2.91, "bcc", 1.39, 51.996), "Fe": (2.87, "bcc", 1.32, 55.845), "Co": (2.51, "hcp", 1.26, 58.933), "Ni": (3.52, "fcc", 1.24, 58.693),
    "Cu": (3.61, "fcc", 1.32, 63.546), "Zn": (2.66, "hcp", 1.22, 65.38), "Mg": (3.21, "hcp", 1.41, 24.305), "Si": (5.43, "diamond", 1.11, 28.085), "O": (None, None, 0.66, 15.999), "H": (None, None, 0.31, 1.008),
}


def elements(spark: SparkSession) -> DataFrame:
    """(symbol, a, lattice, radius, mass): a dimension table to broadcast."""
    return spark.createDataFrame([(s, *v) for s, v in ELEMENTS.items()], "symbol string, a double, lattice string, radius double, mass double")


def neighbour_distance(a: Column, lattice: Column, radius: Column) -> Column:
    """Distance of nearest neighbours; twice the covalent radius where there is no lattice."""
    return F.when(lattice == "fcc", a / math.sqrt(2)).when(lattice == "bcc", a * math.sqrt(3) / 2).when(lattice.isNotNull(), a).otherwise(2 * radius)


def dimers(atoms_of: DataFrame, factor: float = 1.0) -> DataFrame:
    """(id, idx, element, x, y, z) of two atoms of each row's element (id, element, distance)."""
    two = F.array(F.struct(F.lit(0).alias("idx"), F.lit(0.0).alias("x")), F.struct(F.lit(1).alias("idx"), (F.col("distance") * factor).alias("x")))
    return atoms_of.select("id", "element", F.explode(two).alias("p")).select("id", "p.idx", "element", "p.x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))


def octahedral(atoms: DataFrame, centre: str, most: float, repeat: int, seed: int) -> DataFrame:
    """Copies in which each atom of an element moves along one of the six axes by up to ``most``."""
    each = atoms.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    axis = F.floor(6 * seeded.uniform(f"{seed}x", "id", "copy", "idx"))
    size = most * seeded.uniform(f"{seed}s", "id", "copy", "idx")
    shift = {c: F.when(axis == 2 * i, size).when(axis == 2 * i + 1, -size).otherwise(0.0) for i, c in enumerate("xyz")}
    return each.withColumns({c: F.col(c) + F.when(F.col("element") == centre, s).otherwise(0.0) for c, s in shift.items()})


def millers(most: int) -> list[tuple[int, int, int]]:
    """Planes up to a largest index, each once: no common divisor, first non-zero index positive."""
    r = range(-most, most + 1)
    return [(h, k, m) for h in r for k in r for m in r if math.gcd(h, k, m) == 1 and next(x for x in (h, k, m) if x) > 0]


def slab(a: float, lattice: str, plane: tuple[int, int, int], layers: int, vacuum: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell, positions) of a cubic crystal cut along a plane: its atoms within one in-plane cell and ``layers`` spacings."""
    basis = {"fcc": [[0, 0, 0], [0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]], "bcc": [[0, 0, 0], [0.5, 0.5, 0.5]], "sc": [[0, 0, 0]]}[lattice]
    h = np.array(plane)
    n = h / np.linalg.norm(h)
    g = range(-max(abs(h)), max(abs(h)) + 1)
    flat = sorted(([np.array(v) for v in np.array(np.meshgrid(g, g, g)).reshape(3, -1).T if v @ h == 0 and v.any()]), key=lambda v: (v @ v, tuple(v)))
    u = flat[0]
    v = next(w for w in flat if np.linalg.norm(np.cross(u, w)) > 1e-9)
    height = a / np.linalg.norm(h) * layers
    span = int(np.ceil(max(np.abs(u).sum() + np.abs(v).sum(), height / a + 1))) + max(abs(h)) + 1
    grid = np.array(np.meshgrid(*[np.arange(-span, span + 1)] * 3)).reshape(3, -1).T
    pts = (grid[:, None] + np.array(basis)[None]).reshape(-1, 3)
    box = np.array([u, v, n * height / a])
    frac = pts @ np.linalg.inv(box)
    inside = ((frac > -1e-9) & (frac < 1 - 1e-9)).all(1)
    x = u / np.linalg.norm(u)
    turn = np.array([x, np.cross(n, x), n])
    if np.dot(np.cross(u, v), n) < 0:
        v = -v
        box = np.array([u, v, n * height / a])
        frac = pts @ np.linalg.inv(box)
        inside = ((frac > -1e-9) & (frac < 1 - 1e-9)).all(1)
    cell = np.array([u, v, n * (height + vacuum) / a]) @ turn.T * a
    return cell, pts[inside] @ turn.T * a


def slabs(bulks: DataFrame, most: int, layers: int, vacuum: float) -> DataFrame:
    """(id, plane, idx, element, x, y, z, area) for every plane of every bulk (id, element, a, lattice); one row of work per bulk and plane."""
    planes = F.array(*[F.array(*[F.lit(i) for i in p]) for p in millers(most) if min(p) >= 0 and tuple(sorted(p, reverse=True)) == p])
    work = bulks.select("id", "element", "a", "lattice", F.explode(planes).alias("plane"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                cell, pos = slab(r.a, r.lattice, tuple(int(i) for i in r.plane), layers, vacuum)
                area = float(np.linalg.norm(np.cross(cell[0], cell[1])))
                yield pd.DataFrame({"id": r.id, "plane": "".join(str(int(i)) for i in r.plane), "idx": range(len(pos)), "element": r.element, "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "area": area})

    return work.repartition(int(bulks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").mapInPandas(run, f"id {dict(bulks.dtypes)['id']}, plane string, idx int, element string, x double, y double, z double, area double")


def vacuum_wrong(height: Column, atoms_height: Column, wanted: Column, tolerance: float = 0.5) -> Column:
    return F.abs(height - atoms_height - wanted) > tolerance


def adjusted_height(height: Column, atoms_height: Column, wanted: Column, tolerance: float = 0.5) -> Column:
    """The cell height that leaves the wanted vacuum, where it is off by more than the tolerance."""
    return F.when(vacuum_wrong(height, atoms_height, wanted, tolerance), atoms_height + wanted).otherwise(height)


def percentage(low: float, high: float, offset: float, seed: int, *ids: str) -> Column:
    """A share drawn evenly between the two ends of a phase's range, each moved inwards by the offset (in whichever order they then are)."""
    a, b = low + offset, high - offset
    return F.lit(a) + (b - a) * seeded.uniform(seed, *ids)


def replacements_to_fit(n: Column, have: Column, low: float, high: float) -> Column:
    """How many atoms of the base element to add (positive) or take away so that its share lies within [low, high]; the fewest."""
    up = F.ceil(low * n - 1e-9) - have
    down = have - F.floor(high * n + 1e-9)
    return F.when(up > 0, up).when(down > 0, -down).otherwise(F.lit(0)).cast("long")


def with_features(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """(ident, features): the columns as z-scores; a column that does not vary gives zero. The one-row statistics are broadcast."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")), F.lit(0.0)) for c in columns]
    return df.join(F.broadcast(stats)).select(ident, F.array(*z).alias("features"))


def kernel_width(df: DataFrame, ident: str, vector: str, size: int = 10_000, seed: int = 420) -> DataFrame:
    """(n_pairs, p10, median, p90): percentiles of the distances within a seeded sample of stated size (all rows if there are fewer), in one task."""
    from latticework.operators.selection import sample

    if size > 20_000:
        raise ValueError(f"a sample of {size} rows does not fit one task")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = np.array(f[vector].tolist(), float).reshape(len(f), -1)
        sq = (x * x).sum(1)
        d = np.concatenate([np.zeros(0)] + [np.sqrt(np.maximum(sq[i] + sq[i + 1 :] - 2 * (x[i + 1 :] @ x[i]), 0)) for i in range(len(x))])
        p = np.quantile(d, [0.1, 0.5, 0.9]) if len(d) else [None] * 3
        return pd.DataFrame({"n_pairs": [len(d)], "p10": [p[0]], "median": [p[1]], "p90": [p[2]]})

    return sample(df.select(ident, vector), size, seed, ident).groupBy().applyInPandas(run, "n_pairs long, p10 double, median double, p90 double")


def penalties(pairs: DataFrame, least: float, reach: float, power: int = 6, most_ratio: float = 10.0, wanted: float = 2.0, width: float = 0.25) -> DataFrame:
    """(id, repulsion, cohesion) of atom pairs (id, i, j, dist, ri, rj): closeness below a share of the radii, and too few smooth neighbours."""
    sum_r = F.col("ri") + F.col("rj")
    ratio = F.least(F.when(F.col("dist") > 0, least * sum_r / F.col("dist")).otherwise(most_ratio), F.lit(most_ratio))
    rep = F.when((F.col("i") < F.col("j")) & (ratio > 1), F.pow(ratio, power) - 1).otherwise(0.0)
    near = 1 / (1 + F.exp((F.col("dist") - reach * sum_r) / width))
    per = pairs.groupBy("id", "i").agg(F.sum(rep).alias("r"), F.sum(near).alias("c"))
    return per.groupBy("id").agg(F.sum("r").alias("repulsion"), F.sum(F.pow(F.greatest(wanted - F.col("c"), F.lit(0.0)), 2)).alias("cohesion"))


def restrained(moved: DataFrame, start: DataFrame, free: float) -> DataFrame:
    """(id, restraint): squared displacements beyond a free distance."""
    s = start.select("id", "idx", *[F.col(c).alias(f"{c}0") for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"))
    return moved.join(s, ["id", "idx"]).groupBy("id").agg(F.sum(F.pow(F.greatest(d - free, F.lit(0.0)), 2)).alias("restraint"))


def encode(df: DataFrame, ident: str, vector: str, weights: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """(ident, latent): the forward pass of a dense network (ReLU between layers) on standardised vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = (np.array(f[vector].tolist(), float).reshape(len(f), -1) - mean) / np.where(std == 0, 1, std)
            for k, (w, b) in enumerate(weights):
                x = x @ w + b
                x = np.maximum(x, 0) if k < len(weights) - 1 else x
            yield pd.DataFrame({ident: f[ident], "latent": list(x)})

    return df.select(ident, vector).mapInPandas(run, f"{ident} {dict(df.dtypes)[ident]}, latent array<double>")


def reconstruction(df: DataFrame, vector: str, back: str) -> DataFrame:
    """(mae, mse, rmse, relative): of vectors and their reconstructions; relative to the variance of all components."""
    e = df.select(F.explode(F.arrays_zip(F.col(vector).alias("a"), F.col(back).alias("b"))).alias("p")).select(F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    d = F.col("a") - F.col("b")
    out = e.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.var_pop("a").alias("v"))
    return out.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.try_divide("mse", "v").alias("relative"))


def first_layers(atoms: DataFrame, n: int) -> DataFrame:
    """The atoms of the lowest n layers."""
    return atoms.withColumn("_l", F.dense_rank().over(Window.partitionBy("id").orderBy("z"))).where(F.col("_l") <= n).drop("_l")
