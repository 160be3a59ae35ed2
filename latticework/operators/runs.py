"""Rules on run records, training entries, steps of a loop and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gathered(jobs: DataFrame, parsed: Column, state: Column, done: str = "finished") -> DataFrame:
    """The finished jobs whose output could be read."""
    return jobs.where((F.lower(F.trim(state)) == done) & parsed.isNotNull())


def split_outliers(rows: DataFrame, outlier: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, aside): a row of unknown standing is kept."""
    bad = F.coalesce(outlier, F.lit(False))
    return rows.where(~bad), rows.where(bad)


def renamed(info: Column, names: dict[str, str]) -> Column:
    """A map with some keys renamed; a key that is already there under the new name gives way."""
    new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pairs = F.transform(F.map_entries(info), lambda e: F.struct(F.coalesce(F.element_at(new, e["key"]), e["key"]).alias("key"), e["value"].alias("value"), F.element_at(new, e["key"]).isNotNull().alias("mine")))
    keep = F.filter(pairs, lambda e: e["mine"] | ~F.exists(pairs, lambda o: o["mine"] & (o["key"] == e["key"])))
    return F.map_from_entries(F.transform(keep, lambda e: F.struct(e["key"], e["value"])))


def with_info(info: Column, more: Column) -> Column:
    """A record's map with another's entries added; those of the other win."""
    return F.map_concat(F.map_filter(info, lambda k, v: ~F.map_contains_key(more, k)), more)


def without(info: Column, *keys: str) -> Column:
    """A map without some keys."""
    return F.map_filter(info, lambda k, v: ~k.isin(*keys))


def only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The columns that are both there and allowed, in the order of the list."""
    return df.select(*[c for c in allowed if c in df.columns])


def stress(first: Column, second: Column) -> Column:
    """The six values of a stress, of the first source that has six numbers; null if none."""
    six = lambda c: F.when(F.size(c) == 6, c.cast("array<double>"))
    return F.coalesce(six(first), six(second))


def entry(n: Column, info: Column, atoms: Column, drop: tuple[str, ...] = ()) -> Column:
    """One training entry as text: number of atoms, sorted key=value pairs without the dropped ones, and a line per atom (symbol, x, y, z)."""
    pairs = F.array_sort(F.transform(F.map_entries(without(info, *drop) if drop else info), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    line = lambda a: F.format_string("%s %.6f %.6f %.6f", a["symbol"], a["x"], a["y"], a["z"])
    return F.concat_ws("\n", n.cast("string"), F.array_join(pairs, " "), F.array_join(F.transform(atoms, line), "\n"))


def step_number(al_step: Column, iteration: Column) -> Column:
    """The step counted from one: as given, else the iteration counted from zero plus one."""
    return F.coalesce(al_step, iteration + 1)


def level_allowed(level: Column, allowed: list[str]) -> Column:
    return F.upper(level).isin([x.upper() for x in allowed])


def completed_steps(steps: DataFrame, run: str, step: str, state: str) -> DataFrame:
    """(run, n_completed, last): completed steps of every run and the largest, 0 if there is none."""
    done = F.lower(F.trim(state)) == "completed"
    return steps.groupBy(run).agg(F.count_if(done).alias("n_completed"), F.coalesce(F.max(F.when(done, F.col(step))), F.lit(0)).alias("last"))


def state_class(state: Column) -> Column:
    """What a progress bar shows for a state."""
    s = F.lower(F.trim(state))
    return F.when(s.isin("finished", "completed"), "success").when(s.isin("excepted", "killed", "failed"), "danger").when(s.isin("running", "waiting", "created", "submitted"), "active").otherwise("unknown")


#: Processes that fill one node, by its cores.
NODE_CORES = (12, 24, 28)


def scheduler_options(cores: Column, processes: Column) -> Column:
    """(nodes, per_node) for a node type given by its number of cores; without a number of processes one node is filled. Null for other types."""
    known = cores.isin(*NODE_CORES)
    n = F.coalesce(processes, cores)
    return F.when(known, F.struct(F.ceil(n / cores).cast("int").alias("nodes"), F.least(n, cores).cast("int").alias("per_node")))


def step_report(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by, before, after, added): structures of each group before and after a step."""
    count = lambda d, n: d.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    both = count(before, "before").join(count(after, "after"), by, "full_outer").fillna(0, ["before", "after"])
    return both.withColumn("added", F.col("after") - F.col("before"))


def require_ids(rows: DataFrame, key: str) -> None:
    """Raise if an id is missing or occurs twice; one pass, and the first few offenders are named."""
    bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).orderBy(F.col(key).asc_nulls_first()).limit(5).collect()
    if bad:
        raise ValueError("ids missing or repeated: " + ", ".join(f"{r[key]} ({r['n']})" for r in bad))


def diagram_kind(n_elements: Column) -> Column:
    """The kind of phase diagram by its number of elements; an error for any other number."""
    kind = F.when(n_elements == 1, "unary").when(n_elements == 2, "binary").when(n_elements == 3, "ternary")
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("no diagram for elements: "), n_elements.cast("string"))))


def foreign_phases(phases: DataFrame, elements: Column, allowed: list[str]) -> DataFrame:
    """The phases with an element that the diagram does not have."""
    return phases.where(F.size(F.array_except(elements, F.array(*[F.lit(e) for e in allowed]))) > 0)


def feasible_first(feasible: Column, distance: Column, *ties: Column) -> Column:
    """A ranking key: feasible results before others, then the nearer, then the ties; unknown feasibility is none."""
    return F.struct(~F.coalesce(feasible, F.lit(False)), distance.isNull(), distance, *ties)


def best_start(results: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Of each group's starts the first by the ranking key: one aggregation, no window."""
    return results.groupBy(*by).agg(F.min_by(F.struct(*[c for c in results.columns if c not in by]), key).alias("b")).select(*by, "b.*")


def melting_point(shares: DataFrame, by: list[str], temperature: str, solid: str, half: float = 0.5) -> DataFrame:
    """(by, melting): the temperature at which the solid share first falls to a half, by linear interpolation; null if it does not."""
    w = Window.partitionBy(*by).orderBy(temperature)
    t, s = F.col(temperature), F.col(solid)
    t0, s0 = F.lag(t).over(w), F.lag(s).over(w)
    at = F.when((s <= half) & (s0 > half), t0 + (s0 - half) / (s0 - s) * (t - t0))
    return shares.withColumn("_at", at).groupBy(*by).agg(F.min("_at").alias("melting"))


def energy_drift(series: DataFrame, by: list[str], time: str, energy: str) -> DataFrame:
    """(by, n, drift, spread): of an energy during a run: the slope by least squares and the deviation."""
    g = series.groupBy(*by)
    return g.agg(F.count(energy).alias("n"), F.regr_slope(energy, time).alias("drift"), F.coalesce(F.stddev_samp(energy), F.lit(0.0)).alias("spread"))


def excess_energy(total: Column, n: Column, bulk: Column) -> Column:
    """Energy of a cluster beyond its bulk, per surface atom's count n^(2/3)."""
    return (total - n * bulk) / F.pow(n.cast("double"), F.lit(2 / 3))


def next_batch(queue: DataFrame, done: DataFrame, key: str, order: list[str], running: int, most: int) -> DataFrame:
    """What to submit next: queued ids without a result, in order, as many as there are free places."""
    free = max(0, most - running)
    return queue.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key]).orderBy(*order, key).limit(free)


def has_room(running: Column, asked: Column, capacity: Column) -> Column:
    """Whether a scheduler takes so many more; an unknown load counts as none, an unknown capacity has no room."""
    return F.coalesce(F.coalesce(running, F.lit(0)) + F.coalesce(asked, F.lit(0)) <= capacity, F.lit(False))


def unique_name(base: Column, stamp: Column, *parts: Column) -> Column:
    """A model's name: its base, a stamp of date and time, and a short digest of what else tells it apart."""
    return F.concat_ws("_", base, F.date_format(stamp, "yyyyMMdd'T'HHmmss"), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8))


#: Electronvolts of one unit of energy.
ENERGY_UNITS = {"eV": 1.0, "Ha": 27.211386245988, "meV": 1e-3}


def payload(energy: Column, forces: Column, unit: str) -> Column:
    """(energy, forces, largest) of a calculation in a unit of energy (forces per ångström); nulls stay nulls."""
    if unit not in ENERGY_UNITS:
        raise ValueError(f"no unit {unit!r}; there are {sorted(ENERGY_UNITS)}")
    k = 1 / ENERGY_UNITS[unit]
    scaled = F.transform(forces, lambda f: f * k)
    return F.struct((energy * k).alias("energy"), scaled.alias("forces"), F.array_max(F.transform(scaled, lambda f: F.abs(f))).alias("largest"))


def annotated(results: DataFrame, target: list[str], got: list[str], limit: float) -> DataFrame:
    """Results of an inversion with their diagnostics: ``miss`` (distance of what was got to the target) and ``reached`` (within a limit)."""
    miss = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(target, got, strict=True)), F.lit(0.0)))
    return results.withColumn("miss", miss).withColumn("reached", F.coalesce(F.col("miss") <= limit, F.lit(False)))


def located(files: DataFrame, path: str, wanted: list[str]) -> DataFrame:
    """(name, path): of every wanted file name the path that holds it, the shortest and then the first; null where none does."""
    name = F.element_at(F.split(path, "/"), -1)
    best = files.where(name.isin(*wanted)).groupBy(name.alias("name")).agg(F.min(F.struct(F.length(path), F.col(path).alias("path"))).alias("b"))
    names = files.sparkSession.createDataFrame([(w,) for w in wanted], "name string")
    return names.join(best, "name", "left").select("name", "b.path")


def dataset_size(counts: DataFrame, n: str, repeats: dict[str, float], kept: float = 1.0) -> DataFrame:
    """How many structures a configured pipeline makes of each row's count: each stage adds its copies of all before it, then a share is kept."""
    total = F.col(n).cast("double")
    for stage, copies in repeats.items():
        total = total * (1 + copies)
        counts = counts.withColumn(f"after_{stage}", F.floor(total).cast("long"))
    return counts.withColumn("estimate", F.floor(total * kept).cast("long"))
