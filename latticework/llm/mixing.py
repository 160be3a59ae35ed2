"""Mixing sources to target weights, with capped repetition.

Method: min-cost flow for overlapping sources. Documents of equal text are one content; the set of
targeted sources that hold it is its membership pattern. Contents are counted by pattern, and only
these totals reach the driver (at most one per observed set of sources, behind a check). In the
network a pattern's r-th use has an arc of the pattern's tokens at a cost that rises with r (convex
repetition costs), patterns feed the sources of their set, sources have their quota, and a slack
arc takes what a source cannot get: its shortfall.

The total is the largest at which every source reaches its quota, sought by bisection over the flow.
Shares and size pull against each other where a source is small, so how far a source may hold the total
back is stated: ``least`` (LEAST) is the smallest total, as a share of all tokens, that is accepted for
the sake of a share. A source that reaches its share only of a smaller total (such as one without
documents) gives all it has, and its shortfall is reported; ``holds_total`` of the report tells which
sources the total was sought for.

Selection: the contents of a pattern lie in seeded order on a line, one after the other, once for
each permitted use; each source takes the stretch that the flow gave it, and a content is used as
often as it starts in the stretch. Positions come from sums over hash buckets and within one
bucket, so no pattern, however large, is ordered in one task.

A content is used at most as often as the least max_repeats of its pattern's sources allows, in all.

Defined results: null and empty texts and null sources take no part; source names are compared
trimmed, in lower case; equal texts of one source are one document (the smallest doc_id stands for
it); targets with a null or negative share count as zero, null max_repeats as one; of repeated
targets the largest share counts; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import tokens
from latticework.llm.flow import Flow
from latticework.session import materialise

LEAST = 0.1
BUCKETS = 4_096
MOST_SOURCES, MOST_PATTERNS = 10_000, 100_000
SLACK = 1e9


def source_name(c: str):
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def wanted(rows: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and permitted uses by source: a small table by nature, read behind a check of its size."""
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    got = rows.select(source_name("source").alias("source"), share.alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("uses"))
    got = got.where("source is not null").groupBy("source").agg(F.max(F.struct("share", "uses")).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(got) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} mix targets")
    return {r["source"]: (r["t"]["share"], r["t"]["uses"]) for r in sorted(got)}


def route(counts: dict[tuple[str, ...], int], want: dict[str, tuple[float, int]], total: int) -> tuple[dict, dict]:
    """Tokens from each pattern to each of its sources, and each source's shortfall, at a total."""
    net, give, slack = Flow(), {}, {}
    quotas = {s: int(share * total) for s, (share, _) in want.items()}
    for p, n in counts.items():
        for r in range(min(want[s][1] for s in p)):
            net.arc("start", ("pattern", p), n, float((r + 1) ** 2))
        for s in p:
            give[p, s] = net.arc(("pattern", p), ("source", s), min(n * want[s][1], quotas[s]))
    for s, q in quotas.items():
        slack[s] = net.arc("start", ("source", s), q, SLACK)
        net.arc(("source", s), "end", q)
    net.run("start", "end", sum(quotas.values()))
    return {k: net.sent(a) for k, a in give.items()}, {s: net.sent(a) for s, a in slack.items()}


def most_tokens(counts: dict[tuple[str, ...], int], want: dict[str, tuple[float, int]]) -> dict[str, int]:
    """What each source could give at most, its permitted repetitions counted."""
    return {s: sum(n * min(want[x][1] for x in p) for p, n in counts.items() if s in p) for s in want}


def holding(counts: dict[tuple[str, ...], int], want: dict[str, tuple[float, int]], least: float) -> dict[str, tuple[float, int]]:
    """The sources that reach their share of a total of at least ``least`` of all tokens."""
    have = most_tokens(counts, want)
    return {s: w for s, w in want.items() if w[0] > 0 and have[s] >= w[0] * least * sum(counts.values())}


def best_total(counts: dict[tuple[str, ...], int], want: dict[str, tuple[float, int]], least: float = LEAST) -> int:
    """The largest total at which no source falls short but those that cannot reach their share of a small total."""
    have = most_tokens(counts, want)
    held = holding(counts, want, least)
    if not held:
        return 0
    hold = lambda t: not any(route({tuple(x for x in p if x in held): n for p, n in counts.items() if any(x in held for x in p)}, held, t)[1].values())
    low, high = 0, max(1, int(min(have[s] / w[0] for s, w in held.items())))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if hold(mid) else (low, mid - 1)
    return low


def mix(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = tokens.VOCABULARY, total: int | None = None, seed: int = 5, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(mix, report): doc_id, source, uses and n_tokens of what is used; and per source what was asked, there and reached."""
    spark = documents.sparkSession
    want = wanted(mix_targets)
    names = F.array(*[F.lit(s) for s in want]).cast("array<string>")
    docs = documents.select("doc_id", source_name("source").alias("source"), "text").where("text is not null and text != ''").where(F.array_contains(names, F.col("source")))
    sized = materialise(tokens.sizes(docs.withColumn("content", F.md5("text")), vocabulary, keep=("source", "content")), "sized")
    held = sized.groupBy("content", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    held = materialise(held, "held")
    contents = held.groupBy("content").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n"))
    contents = materialise(contents.withColumn("h", F.xxhash64(F.lit(seed), "content")), "contents")
    got = contents.groupBy("pattern").agg(F.sum("n").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(got) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources share documents")
    counts = {tuple(r["pattern"]): r["n"] for r in sorted(got, key=lambda r: r["pattern"])}
    total = best_total(counts, want, least) if total is None else total
    sought = holding(counts, want, least)
    sent, _ = route(counts, want, total)
    stretches = []
    for p in counts:
        at = 0
        for s in p:
            stretches.append((list(p), s, at, at + sent[p, s], counts[p]))
            at += sent[p, s]
    lines = spark.createDataFrame(stretches, "pattern array<string>, source string, low long, high long, length long")
    by = contents.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1))
    sums = by.groupBy("pattern", "bucket").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("start", F.sum("held").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("held")).drop("held")
    inner = F.sum("n").over(Window.partitionBy("pattern", "bucket").orderBy("h", "content").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = by.withColumn("inner", inner).join(sums, ["pattern", "bucket"]).withColumn("at", F.col("start") + F.col("inner"))
    up = lambda x: F.ceil(F.greatest(F.col(x) - F.col("at"), F.lit(0)) / F.col("length"))
    used = placed.join(F.broadcast(lines), "pattern").withColumn("uses", (up("high") - up("low")).cast("int")).where("uses > 0")
    out = used.select("content", "source", "uses").join(held, ["content", "source"]).select("doc_id", "source", "uses", "n_tokens")
    target = spark.createDataFrame([(s, w, u, int(w * total), s in sought) for s, (w, u) in want.items()], "source string, target_share double, max_repeats int, quota_tokens long, holds_total boolean")
    there = held.groupBy("source").agg(F.count(F.lit(1)).alias("documents_there"), F.sum("n_tokens").alias("tokens_there"))
    reached = out.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    told = F.broadcast(target).join(there, "source", "left").join(reached, "source", "left").fillna(0)
    share = F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy(F.lit(1))))
    told = told.withColumn("share_reached", F.round(F.coalesce(share, F.lit(0.0)), 6)).withColumn("shortfall_tokens", F.greatest(F.col("quota_tokens") - F.col("tokens_used"), F.lit(0)))
    return out, told
