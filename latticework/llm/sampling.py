"""A sample whose categories have given shares, with a minimum from each and a report of what could not be met.

Method: min-cost flow on cross-classified cell counts. Rows are counted by cell: which of a request's
categories a row lists (its pattern), crossed with the fields of the other requests. Only these counts
reach the driver; categories that no request names count as one, so their number is bounded by the
targets table, whatever the number of rows, and it is checked (MOST_CELLS). In the network a gate lets
``sample_size`` rows through to the patterns, whose arcs carry their availability; patterns feed the
categories they list; a category's margin arc carries its target and slack arcs feed what no pattern can,
at one price for the minimum (the floor) and a lower one for the rest. What slack arcs carry is the
shortfall that the report gives. Rows that no target asks for fill the sample up over arcs beyond the
margins, dearer the more a category exceeds its target (``fill``; without it the sample is smaller).
So size goes before exact shares: where rows lack, the report shows the shares that came out.

A pattern that lists several categories (shares may overlap) counts for all of them, which no arc of a
network can carry. It is in the network all the same, billed to one of its categories; from there
exchanges of up to two rows' patterns for two others lower the cost until none does, and the slack arcs
of the network with these quotas give the shortfall. ``gap_rows`` of the report is that shortfall less a
lower bound from a relaxed network: 0 where the plan is proven the best.

Quotas of patterns are spread over their cross-classified cells in proportion to availability with
random rounding, and each cell's quota is drawn by a seeded hash: the hash is cut at the bucket
that completes the quota, so that only rows of that bucket are ranked, whatever the size of a cell.

Defined results: an id counts once, by its latest row (of equally late ones the one still there, then
the larger values), and not if that row is removed; ids that are no reference take no part. Letter
case, blanks and underscores of categories do not matter. Modifications are read from any quoted list;
what cannot be read lists nothing. A request without usable shares draws in proportion from all rows.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.ids import id_key
from latticework.llm.flow import Flow
from latticework.session import materialise

FIELDS = ("phase", "struct_type", "modifications")
BUCKETS = 4_096
#: Prices, in this order of importance: a row that a floor lacks, one that a target lacks, one beyond the target; one of no category.
FLOOR, TARGET, BEYOND, UNNAMED = 1e6, 1e3, 1.0, 50.0
MOST_REQUESTS, MOST_CELLS, MOST_BROADCAST = 100_000, 200_000, 100_000
#: Patterns up to which all exchanges of two for two are tried; beyond, those of patterns that differ in one category.
MOST_PAIRS = 20


def category(c: Column | str) -> Column:
    """A category's comparable form; null if empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[\s_​ ]+", " ")), F.lit("")).alias("c")


def listed(c: Column | str) -> Column:
    """The distinct modifications that a quoted list names."""
    c = F.col(c) if isinstance(c, str) else c
    names = F.transform(F.regexp_extract_all(c, F.lit("[\"']([^\"']+)[\"']"), 1), lambda x: F.replace(category(x), F.lit(" "), F.lit("_")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), F.array().cast("array<string>"))


def current(structures: DataFrame) -> DataFrame:
    """(key, phase, struct_type, modifications): the structures that are there, each once."""
    last = F.max(F.struct(F.col("recorded_at"), F.col("removed_at").isNull().alias("there"), F.col("removed_at"), F.col("phase"), F.col("struct_type"), F.col("modifications")))
    rows = structures.select(id_key("atl_id").alias("key"), "recorded_at", "removed_at", "phase", "struct_type", "modifications").where("key is not null")
    rows = rows.groupBy("key").agg(last.alias("s")).where("s.there")
    one = lambda f: F.replace(category(f"s.{f}"), F.lit(" "), F.lit("_")).alias(f)
    return rows.select("key", one("phase"), one("struct_type"), listed("s.modifications").alias("modifications"))


def targets(rows: DataFrame) -> dict[int, dict]:
    """The requests, by number: a small table by nature, read to the driver behind a check of its size."""
    name = F.replace(category("category"), F.lit(" "), F.lit("_")).alias("category")
    got = rows.select("request_id", "sample_size", F.lower(F.trim("field_name")).alias("field"), name, "target_share", "min_rows").distinct().limit(MOST_REQUESTS + 1).collect()
    if len(got) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} sampling targets")
    out: dict[int, dict] = {}
    for r in sorted(got, key=lambda r: (r["request_id"] is None, r["request_id"] or 0, r["category"] or "")):
        if r["request_id"] is None or r["field"] not in FIELDS or r["category"] is None:
            continue
        q = out.setdefault(r["request_id"], {"size": max(0, r["sample_size"] or 0), "field": r["field"], "cats": {}})
        q["cats"][r["category"]] = (max(0.0, r["target_share"] or 0.0), max(0, r["min_rows"] or 0))
    return out


def goals(q: dict) -> dict[str, int]:
    """Target rows by category: shares of the size, rounded so that their sum is right (overlapping shares each by themselves)."""
    exact = {c: s * q["size"] for c, (s, _) in q["cats"].items()}
    whole = {c: int(x + 1e-9) for c, x in exact.items()}
    rest = round(sum(exact.values())) - sum(whole.values())
    for c in sorted(exact, key=lambda c: (whole[c] - exact[c], c))[: max(0, rest)]:
        whole[c] += 1
    return whole


def _price(rows: int, goal: int, floor: int) -> float:
    """Cost of a category's rows: its slack, and what its arcs beyond the target add up to."""
    need = max(goal, floor)
    over = max(0, rows - need)
    return FLOOR * max(0, floor - rows) + TARGET * (max(0, need - rows) - max(0, floor - rows)) + BEYOND * over * (1 + over / max(goal, 1))


@dataclass
class Plan:
    """Rows to draw from each pattern, what slack arcs carried by category (of the floor, of all), and the distance to a lower bound."""

    quota: dict[tuple[str, ...], int]
    floor_short: dict[str, int]
    short: dict[str, int]
    gap: int = 0


def _margins(net: Flow, need: dict[str, int], floor: dict[str, int]) -> tuple[dict, dict]:
    """Margin and slack arcs of the categories; the numbers of the slack arcs (of the floor, of the rest)."""
    low, rest = {}, {}
    for c, n in need.items():
        net.arc(("category", c), "end", n)
        low[c] = net.arc("start", ("category", c), min(floor[c], n), FLOOR)
        rest[c] = net.arc("start", ("category", c), n - min(floor[c], n), TARGET)
    return low, rest


def plan(q: dict, counts: dict[tuple[str, ...], int], fill: bool = True) -> Plan:
    """Rows to draw from each pattern (the categories of the request that a row lists)."""
    goal, size = goals(q), q["size"]
    floor = {c: m for c, (_, m) in q["cats"].items()}
    need = {c: max(goal[c], floor[c]) for c in goal}
    net = Flow()
    net.arc("start", "gate", size)
    low, rest = _margins(net, need, floor)
    arcs = {p: net.arc("gate", ("pattern", p), n) for p, n in counts.items()}
    for p, n in counts.items():
        for c in p:
            net.arc(("pattern", p), ("category", c), n)
    net.run("start", "end", sum(need.values()))
    slack = lambda: ({c: net.sent(k) for c, k in low.items()}, {c: net.sent(low[c]) + net.sent(rest[c]) for c in low})
    floor_short, short = slack()
    overlapping = any(len(p) > 1 for p in counts)
    if fill and not overlapping:
        for k in (*low.values(), *rest.values()):  # slack serves the margins alone
            net.cap[k] = 0
        for c in need:
            over, step = 0, max(1, goal[c] // 50)
            while over < size:  # ever dearer, by its fiftieth, later by more
                take = min(step, size - over)
                net.arc(("category", c), "over", take, BEYOND * (1 + 2 * (over + take / 2) / max(goal[c], 1)))
                over += take
                step = step if over < max(goal[c], 50 * step) else step * 2
        if () in counts:
            net.arc(("pattern", ()), "over", counts[()], UNNAMED)
        net.run("start", "over", size)
    quota = {p: net.sent(k) for p, k in arcs.items()}
    if not overlapping:
        return Plan(quota, floor_short, short)
    quota = _exchange(quota, counts, goal, floor, size, fill)
    settled = Flow()
    low, rest = _margins(settled, need, floor)
    for c in need:
        settled.arc("start", ("category", c), sum(n for p, n in quota.items() if c in p))
    settled.run("start", "end", sum(need.values()))
    short = {c: settled.sent(low[c]) + settled.sent(rest[c]) for c in need}
    return Plan(quota, {c: settled.sent(low[c]) for c in need}, short, sum(short.values()) - _least_short(counts, need, size))


def _least_short(counts: dict, need: dict[str, int], size: int) -> int:
    """A lower bound of the shortfall: as if a row's listings could be given to its categories one by one."""
    listings, left = 0, size
    for p in sorted(counts, key=len, reverse=True):
        take = min(left, counts[p])
        listings, left = listings + take * len(p), left - take
    net = Flow()
    net.arc("start", "gate", listings)
    for p, n in counts.items():
        net.arc("gate", ("pattern", p), n * len(p))
        for c in p:
            net.arc(("pattern", p), ("category", c), n)
    for c, n in need.items():
        net.arc(("category", c), "end", n)
    return sum(need.values()) - net.run("start", "end", sum(need.values()))


def _exchange(quota: dict, counts: dict, goal: dict, floor: dict, size: int, fill: bool) -> dict:
    """Lower the cost by taking patterns' rows for others', up to two for two, or by adding rows, while that helps."""
    have = {c: sum(n for p, n in quota.items() if c in p) for c in goal}
    used = sum(quota.values())
    patterns = sorted(counts)

    def worth(less: tuple, more: tuple, k: int) -> float:
        change: dict = defaultdict(int)
        for side, sign in ((less, -k), (more, k)):
            for p in side:
                for c in p:
                    change[c] += sign
        unnamed = sum(p == () for p in more) - sum(p == () for p in less)
        cost = UNNAMED * k * unnamed + sum(_price(have[c] + d, goal[c], floor[c]) - _price(have[c], goal[c], floor[c]) for c, d in change.items() if d)
        return cost - (TARGET / 2 * k * (len(more) - len(less)) if fill else 0)

    def fits(less: tuple, more: tuple, k: int) -> bool:
        if used + k * (len(more) - len(less)) > size:
            return False
        return all(quota[p] >= k * less.count(p) for p in less) and all(counts[p] - quota[p] >= k * more.count(p) for p in more)

    def near(p: tuple) -> list[tuple]:
        one = {tuple(sorted({*p} ^ {c})) for c in goal}
        return [x for x in one | {tuple(sorted(({*p} - {a}) | {c})) for a in p for c in goal} if x in counts and x != p]

    few = len(patterns) <= MOST_PAIRS
    singles = [((), (p,)) for p in patterns] + ([((p,), ()) for p in patterns] if not fill else [])
    singles += [((a,), (b,)) for a in patterns for b in (patterns if few else near(a)) if a != b]
    pairs = list(combinations_with_replacement(patterns, 2)) if few else []
    moves = singles + [(a, b) for a in pairs for b in pairs if not set(a) & set(b)] + [(a, (b,)) for a in pairs for b in patterns if b not in a] + [((b,), a) for a in pairs for b in patterns if b not in a]
    step = 1 << max(0, size.bit_length() - 2)
    while step:
        moved = False
        for less, more in moves:
            while fits(less, more, step) and worth(less, more, step) < -1e-9:
                for side, sign in ((less, -step), (more, step)):
                    for p in side:
                        quota[p] += sign
                        for c in p:
                            have[c] += sign
                used += step * (len(more) - len(less))
                moved = True
        if not moved:
            step //= 2
    return quota


def spread(n: int, cells: dict, rng: random.Random) -> dict:
    """A quota over cells in proportion to what they hold, with random rounding; no cell gives more than it has."""
    total = sum(cells.values())
    exact = {c: n * h / total for c, h in cells.items()} if total else {}
    out = {c: int(x) for c, x in exact.items()}
    rest = n - sum(out.values())
    order = sorted(exact, key=lambda c: rng.random() ** (1 / max(exact[c] - out[c], 1e-9)), reverse=True)
    while rest > 0:
        before = rest
        for c in order:
            if rest and out[c] < cells[c]:
                out[c] += 1
                rest -= 1
        if rest == before:
            break
    return out


def _classified(rows: DataFrame, requests: dict[int, dict]) -> DataFrame:
    """(key, phase, struct_type, modifications): categories that no request names become null."""
    named = {f: sorted({c for q in requests.values() if q["field"] == f for c in q["cats"]}) for f in FIELDS}
    lits = lambda f: F.array(*[F.lit(c) for c in named[f]]).cast("array<string>")
    keep = lambda f: F.when(F.array_contains(lits(f), F.col(f)), F.col(f)).alias(f)
    return rows.select("key", keep("phase"), keep("struct_type"), F.array_sort(F.array_intersect("modifications", lits("modifications"))).alias("modifications"))


def draw(structures: DataFrame, sampling_targets: DataFrame, seed: int = 11, fill: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sample, report): request_id, key and its categories; and per request and category what was asked, there and drawn."""
    spark = structures.sparkSession
    requests = targets(sampling_targets)
    rows = materialise(_classified(current(structures), requests), "classified")  # counted and drawn from
    held = rows.groupBy(*FIELDS).count().limit(MOST_CELLS + 1).collect() if requests else []
    if len(held) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of named categories")
    cells = {(r["phase"], r["struct_type"], tuple(r["modifications"])): r["count"] for r in held}
    quotas, report = [], []
    for rid, q in requests.items():
        at = FIELDS.index(q["field"])
        by: dict = defaultdict(dict)
        for cell, n in cells.items():
            names = cell[2] if at == 2 else (cell[at],) if cell[at] is not None else ()
            by[tuple(sorted(set(names) & set(q["cats"])))][cell] = n
        counts = {p: sum(c.values()) for p, c in by.items()}
        made = plan(q, counts, fill)
        quota = made.quota
        rng = random.Random(f"{seed}:{rid}")
        for p in sorted(by):
            quotas += [(rid, *cell[:2], list(cell[2]), k) for cell, k in sorted(spread(quota[p], by[p], rng).items(), key=str) if k]
        drawn = sum(quota.values())
        for c, goal in goals(q).items():
            share, least = q["cats"][c]
            got, there = (sum(n for p, n in z.items() if c in p) for z in (quota, counts))
            why = "met" if got >= max(goal, least) else "too few rows" if got >= there else "other targets"
            report.append((rid, q["size"], drawn, q["field"], c, share, least, goal, there, got, got / drawn if drawn else 0.0, made.short[c], made.floor_short[c], made.gap, why))
    form = "request_id int, phase string, struct_type string, modifications array<string>, quota long"
    want = spark.createDataFrame(quotas, form)
    told = spark.createDataFrame(report, "request_id int, sample_size long, drawn_rows long, field_name string, category string, target_share double, min_rows long, target_rows long, available_rows long, category_rows long, reached_share double, shortfall_rows long, minimum_shortfall_rows long, gap_rows long, outcome string")
    same = F.col("r.phase").eqNullSafe(F.col("q.phase")) & F.col("r.struct_type").eqNullSafe(F.col("q.struct_type")) & (F.col("r.modifications") == F.col("q.modifications"))
    hint = F.broadcast if len(quotas) <= MOST_BROADCAST else (lambda x: x)
    each = rows.alias("r").join(hint(want).alias("q"), same).select("request_id", "quota", "key", *[f"r.{f}" for f in FIELDS])
    each = each.withColumn("h", F.xxhash64(F.lit(seed), "request_id", "key")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1).cast("int"))
    cell = ["request_id", *FIELDS]
    held = each.groupBy(*cell, "quota", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = held.withColumn("before", before).where(F.col("before") < F.col("quota")).groupBy(*cell).agg(F.max("bucket").alias("last"))
    near = each.alias("e").join(hint(cut).alias("c"), F.expr(" and ".join(f"e.{c} <=> c.{c}" for c in cell))).where(F.col("bucket") <= F.col("last"))
    near = near.select("e.*").withColumn("nth", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "key")))
    return near.where(F.col("nth") <= F.col("quota")).select("request_id", "key", *FIELDS), told
