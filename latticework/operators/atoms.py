"""Operators on atom rows (id, idx, element, x, y, z): geometry checks and generators of new structures.

Pairs are only ever formed between the atoms of one structure, whose number is small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import seeded


def _together(atoms: DataFrame, radius: Column) -> DataFrame:
    """(id, a): the atoms of each structure as one array, by one shuffle."""
    one = F.struct("idx", "x", "y", "z", radius.cast("double").alias("r"))
    return atoms.select("id", one.alias("a")).groupBy("id").agg(F.collect_list("a").alias("a"))


def _distance(u: Column, v: Column) -> Column:
    return F.sqrt(sum((u[c] - v[c]) * (u[c] - v[c]) for c in "xyz"))


def pairs(atoms: DataFrame, radius: Column | None = None) -> DataFrame:
    """(id, i, j, dist, and the radii ri, rj): ordered pairs of atoms of one structure.

    A structure's atoms come together once and are unfolded twice, row by row; nothing is joined.
    """
    both = _together(atoms, radius if radius is not None else F.lit(1.0)).select("id", "a", F.explode("a").alias("u")).select("id", "u", F.explode("a").alias("v"))
    u, v = F.col("u"), F.col("v")
    return both.where(u["idx"] != v["idx"]).select("id", u["idx"].alias("i"), v["idx"].alias("j"), _distance(u, v).alias("dist"), u["r"].alias("ri"), v["r"].alias("rj"))


def coordination(atoms: DataFrame, radius: Column, multiplier: float) -> DataFrame:
    """(id, idx, coord): neighbours within multiplier times the sum of radii; counted within each structure's array."""
    near = lambda u: F.size(F.filter("a", lambda v: (v["idx"] != u["idx"]) & (_distance(u, v) <= multiplier * (u["r"] + v["r"]))))
    each = F.transform("a", lambda u: F.struct(u["idx"].alias("idx"), near(u).cast("long").alias("coord")))
    return _together(atoms, radius).select("id", F.explode(each).alias("c")).select("id", "c.idx", "c.coord")


def neighbour_filters(atoms: DataFrame, radius: Column, multiplier: float, least: int = 0, low: int = 3, share: float = 0.5) -> DataFrame:
    """Per structure: has an atom with at most ``least`` neighbours; has too many atoms with at most ``low``."""
    c = coordination(atoms, radius, multiplier).groupBy("id")
    return c.agg((F.min("coord") <= least).alias("no_neighbors"), (F.avg((F.col("coord") <= low).cast("double")) > share).alias("low_coordination"))


def closest_pair(atoms: DataFrame, radius: Column) -> DataFrame:
    """(id, ratio, i, j): the least distance in sums of radii, and the pair that has it."""
    p = pairs(atoms, radius).where("i < j").withColumn("ratio", F.col("dist") / (F.col("ri") + F.col("rj")))
    return p.groupBy("id").agg(F.min(F.struct("ratio", "i", "j")).alias("m")).select("id", "m.ratio", "m.i", "m.j")


def lennard_jones(atoms: DataFrame, epsilon: float = 1.0, sigma: float = 1.0) -> DataFrame:
    """(id, energy): the classical pair energy; a single atom has none."""
    s6 = F.pow(F.lit(sigma) / F.col("dist"), 6)
    e = pairs(atoms).where("i < j and dist > 0").groupBy("id").agg(F.sum(4 * epsilon * (s6 * s6 - s6)).alias("e"))
    return atoms.select("id").distinct().join(e, "id", "left").select("id", F.coalesce("e", F.lit(0.0)).alias("energy"))


def exposed(atoms: DataFrame, lateral: float, top: float = 0.1) -> DataFrame:
    """Atoms of the top layer, and atoms under no other atom within a lateral distance."""
    high = atoms.withColumn("zmax", F.max("z").over(Window.partitionBy("id")))
    over = atoms.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    dist = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    below = high.where(F.col("z") < F.col("zmax") - top).join(over, (F.col("id") == F.col("id2")) & (F.col("z2") > F.col("z") + 0.1) & (dist < lateral), "left_anti")
    return high.where(F.col("z") >= F.col("zmax") - top).unionByName(below).drop("zmax")


def bottom_layers(atoms: DataFrame, n: int) -> DataFrame:
    """``fixed``: whether an atom lies in one of the lowest n layers."""
    return atoms.withColumn("fixed", F.dense_rank().over(Window.partitionBy("id").orderBy("z")) <= n)


def to_bottom(atoms: DataFrame, offset: float = 2.0) -> DataFrame:
    return atoms.withColumn("z", F.col("z") - F.min("z").over(Window.partitionBy("id")) + offset)


def centred(atoms: DataFrame, box: float) -> DataFrame:
    """Moved so that the middle of the atoms' extent is the middle of the box."""
    w = Window.partitionBy("id")
    return atoms.withColumns({c: F.col(c) - (F.min(c).over(w) + F.max(c).over(w)) / 2 + box / 2 for c in "xyz"})


def centre_of_mass(atoms: DataFrame, mass: Column) -> DataFrame:
    return atoms.groupBy("id").agg(*[(F.sum(mass * F.col(c)) / F.sum(mass)).alias(c) for c in "xyz"])


def rattled(atoms: DataFrame, repeat: int, std: float, seed: int) -> DataFrame:
    """Each structure ``repeat`` times with normal displacements; (id, copy, idx, ...)."""
    each = atoms.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    return each.withColumns({c: F.col(c) + std * seeded.normal(f"{seed}{c}", "id", "copy", "idx") for c in "xyz"})


def deformed(cells: DataFrame, entry: str, low: float, high: float, repeat: int, seed: int) -> DataFrame:
    """Cell entries (id, k, entry) scaled by 1 +- a fraction within [low, high); zero stays zero."""
    each = cells.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    part = low + (high - low) * seeded.uniform(seed, "id", "copy", "k")
    sign = F.when(seeded.uniform(f"{seed}s", "id", "copy", "k") < 0.5, -1.0).otherwise(1.0)
    return each.withColumn(entry, F.col(entry) * (1 + sign * part))


def with_vacancies(atoms: DataFrame, low: float, high: float, seed: int) -> DataFrame:
    """Of each structure a share of atoms within [low, high) is left out at random; at least one stays."""
    w = Window.partitionBy("id")
    n = F.count(F.lit(1)).over(w)
    drop = F.least(F.floor(n * (low + (high - low) * seeded.uniform(seed, "id"))), n - 1)
    nth = F.row_number().over(w.orderBy(seeded.uniform(f"{seed}v", "id", "idx"), "idx"))
    return atoms.withColumn("_keep", nth > drop).where("_keep").drop("_keep")


def replaced(atoms: DataFrame, old: str, new: str, count: Column, seed: int) -> DataFrame:
    """``count`` atoms of an element, at random, become another element."""
    nth = F.row_number().over(Window.partitionBy("id", F.col("element") == old).orderBy(seeded.uniform(seed, "id", "idx"), "idx"))
    return atoms.withColumn("element", F.when((F.col("element") == old) & (nth <= count), new).otherwise(F.col("element")))


def supercells(cells: DataFrame, n_atoms: str, low: int, high: int, most: int = 5) -> DataFrame:
    """Repetitions (a, b, c) of each cell whose atom count lies strictly between the limits."""
    r = F.sequence(F.lit(1), F.lit(most))
    each = cells.withColumn("a", F.explode(r)).withColumn("b", F.explode(r)).withColumn("c", F.explode(r))
    n = F.col(n_atoms) * F.col("a") * F.col("b") * F.col("c")
    return each.where((n > low) & (n < high)).withColumn("total", n)


def magic_numbers(n_max: int = 25) -> Column:
    """Atoms of closed cuboctahedral shells."""
    return F.transform(F.sequence(F.lit(1), F.lit(n_max)), lambda n: ((10 * n * n * n + 15 * n * n + 11 * n) / 3).cast("long") + 1)


def reciprocal_lengths(cell: Column) -> Column:
    """Lengths of the reciprocal vectors (with 2 pi) of a cell of nine numbers, row by row; null for a flat cell."""
    import math

    v = [[cell[3 * i + j] for j in range(3)] for i in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    volume = F.abs(sum(p * q for p, q in zip(v[0], cross(v[1], v[2]), strict=True)))
    norm = lambda a: F.sqrt(sum(x * x for x in a))
    return F.array(*[2 * math.pi * F.try_divide(norm(cross(v[(i + 1) % 3], v[(i + 2) % 3])), volume) for i in range(3)])


def kmesh(reciprocal: Column, spacing: float, vacuum_axis: Column | None = None) -> Column:
    """Points per axis for reciprocal lengths: length over spacing, rounded half-even, at least one; one along a vacuum axis."""
    points = lambda x: F.greatest(F.lit(1), F.bround(x / spacing).cast("int"))
    return F.transform(reciprocal, lambda x, i: F.when(vacuum_axis == i, 1).otherwise(points(x)) if vacuum_axis is not None else points(x))
