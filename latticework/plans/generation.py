"""The generation of a first database as a chain of operators on atom rows (id, idx, element, x, y, z).

Every stage takes and gives a table; rows of all structures go through a stage at once, so the chain is one plan per
structure type, cut only where a stage's counts are wanted. ``Settings`` switches stages off by zero or None.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import seeded
from latticework.operators import atoms as A
from latticework.operators import checks


@dataclass
class Settings:
    repeats: int = 2
    most_atoms: int = 64
    replace: tuple[str, str, int] | None = None
    rattle: float = 0.05
    copies: int = 1
    vacancies: tuple[float, float] | None = (0.1, 0.3)
    whole: float | None = 0.95
    per_phase: int | None = None
    adsorbate: tuple[str, float, float] | None = None
    seed: int = 0


def expanded(atoms: DataFrame, repeats: int, length: Column) -> DataFrame:
    """Every structure repeated along its three axes (an orthogonal cell of the given edge): ids stay, atoms are numbered anew."""
    r = F.sequence(F.lit(0), F.lit(repeats - 1))
    each = atoms.withColumn("_a", F.explode(r)).withColumn("_b", F.explode(r)).withColumn("_c", F.explode(r))
    n = ((F.col("_a") * repeats + F.col("_b")) * repeats + F.col("_c")).cast("int")
    moved = {c: F.col(c) + F.col(f"_{k}") * length for c, k in zip("xyz", "abc", strict=True)}
    return each.withColumn("idx", F.col("idx") * repeats**3 + n).withColumns(moved).drop("_a", "_b", "_c")


def bulk_variants(prototypes: DataFrame, length: Column, s: Settings) -> DataFrame:
    """(id, copy, idx, element, x, y, z): supercells of prototypes up to a size, with replaced atoms, each in several rattled copies."""
    cells = expanded(prototypes.join(fitting(prototypes, s), "id", "left_semi"), s.repeats, length)
    if s.replace:
        old, new, count = s.replace
        cells = A.replaced(cells, old, new, F.lit(count), s.seed)
    return A.rattled(cells, s.copies, s.rattle, s.seed)


def fitting(prototypes: DataFrame, s: Settings) -> DataFrame:
    """(id): the prototypes whose supercells have at most ``most_atoms`` atoms, counted before they are repeated."""
    return prototypes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * s.repeats**3 <= s.most_atoms).select("id")


def symmetrical(atoms: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One atom of each set that inversion through the centre of the atoms maps on another of the same element: (id, idx, paired)."""
    w = [F.avg(c).alias(f"m{c}") for c in "xyz"]
    centre = atoms.groupBy("id").agg(*w)
    place = lambda c, sign: F.round((F.col(c) - F.col(f"m{c}")) * sign / tolerance).cast("long")
    own = atoms.join(centre, "id")
    a = own.select("id", "idx", "element", *[place(c, 1).alias(f"k{c}") for c in "xyz"])
    b = own.select("id", "element", *[place(c, -1).alias(f"k{c}") for c in "xyz"]).distinct().withColumn("_hit", F.lit(True))
    return a.join(b, ["id", "element", "kx", "ky", "kz"], "left").select("id", "idx", F.coalesce("_hit", F.lit(False)).alias("paired"))


def vacancies(atoms: DataFrame, radius: Column, low: float, high: float, seed: int, whole: float | None = 0.95, multiplier: float = 1.1) -> DataFrame:
    """Structures with a share of their atoms left out, without those that fell into fragments by it."""
    left = A.with_vacancies(atoms, low, high, seed)
    if whole is None:
        return left
    fine = checks.fragments(left, radius, multiplier).where(F.col("largest_fraction") >= whole).select("id")
    return left.join(fine, "id", "left_semi")


def capped(structures: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """At most so many ids of each phase, drawn at random: a window over ids, not atoms."""
    from pyspark.sql import Window

    ids = structures.select("id", by).distinct()
    nth = F.row_number().over(Window.partitionBy(by).orderBy(seeded.uniform(seed, "id"), "id"))
    return structures.join(ids.withColumn("_n", nth).where(F.col("_n") <= most).select("id"), "id", "left_semi")


def generate(prototypes: DataFrame, length: Column, radius: Column, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(atoms with phase, report): bulk supercells, vacancies without fragments, a limit per phase, adsorbates; and the structures after each stage.

    ``prototypes`` (id, phase, idx, element, x, y, z). A stage stores only the names of its structures: all draws are seeded by
    a structure's own names, so the atoms of those that are left at the end are made once, from their prototypes, and stored then.
    """
    from latticework.session import materialise

    key = F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string"))
    stages = []

    def counted(name: str, names: DataFrame) -> None:
        stages.append(names.groupBy("phase").agg(F.countDistinct("id").alias("n")).withColumn("stage", F.lit(name)))

    def bulk(left: DataFrame) -> DataFrame:
        of = prototypes.drop("phase").join(left.select(F.col("of").alias("id")).distinct(), "id", "left_semi")
        return bulk_variants(of, length, s).withColumn("id", key).drop("copy").join(left.select("id"), "id", "left_semi")

    prototypes = materialise(prototypes, "prototypes")
    phases = prototypes.select("id", "phase").distinct()
    names = fitting(prototypes, s).join(phases, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(s.copies))))
    names = materialise(names.select(F.col("id").alias("of"), key.alias("id"), "phase"), "bulk")
    counted("bulk", names)
    if s.vacancies:
        if s.whole is not None:  # else every structure keeps an atom, so all go on
            fine = checks.fragments(A.with_vacancies(bulk(names), *s.vacancies, s.seed), radius, 1.1).where(F.col("largest_fraction") >= s.whole)
            names = materialise(names.join(fine.select("id"), "id", "left_semi"), "vacancies")
        counted("vacancies", names)
    if s.per_phase is not None:
        names = materialise(capped(names, "phase", s.per_phase, s.seed), "limit")
        counted("limit", names)
    held = bulk(names)
    if s.vacancies:
        held = vacancies(held, radius, *s.vacancies, s.seed, None)
    if s.adsorbate:
        element, height, lateral = s.adsorbate
        held = materialise(held, "held")
        held = checks.with_adsorbate(held, A.exposed(held, lateral), element, height, s.seed)
    held = materialise(held.join(names.select("id", "phase").distinct(), "id"), "generated")
    if s.adsorbate:
        counted("adsorbates", held)
    report = stages[0]
    for st in stages[1:]:
        report = report.unionByName(st)
    return held, report.select("stage", "phase", "n")
