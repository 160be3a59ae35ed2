"""Small rules on text: statuses, names, scheduler output, settings, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_sentence(inside: Column, outside: Column, out: Column, total: Column) -> Column:
    """Counts in words; n/a where there are no frames."""
    pct = lambda c: F.format_string("%.1f", F.floor(1000.0 * c / F.nullif(total, F.lit(0)) + 0.5) / 10)
    return F.when(F.coalesce(total, F.lit(0)) == 0, "n/a").otherwise(F.concat(inside.cast("string"), F.lit(" interpolating ("), pct(inside), F.lit(" %), "), outside.cast("string"), F.lit(" extrapolating ("), pct(outside), F.lit(" %), "), out.cast("string"), F.lit(" out of domain")))


def node_status(state: Column, exit_status: Column) -> Column:
    s = F.lower(state)
    return F.when(s == "finished", F.when(exit_status == 0, "completed").otherwise("failed")).when(s.isin("excepted", "killed"), "failed").when(s.isin("created", "waiting", "running"), "running").otherwise("unknown")


#: Other names of calculation types.
CALC_TYPES = {"scf": "static", "static": "static", "single_point": "static", "relax": "relaxation", "relaxation": "relaxation", "opt": "relaxation", "vc-relax": "relaxation", "md": "md", "bands": "bands", "dos": "dos"}


def calc_type(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CALC_TYPES.items() for x in kv])
    return F.try_element_at(m, F.lower(F.trim(c)))


def model_backend(spec: Column, known: list[str], default: str) -> Column:
    """The backend of ``backend:variant``; text before a colon that is no known backend belongs to the variant."""
    head = F.split_part(spec, F.lit(":"), F.lit(1))
    return F.when(F.contains(spec, F.lit(":")) & head.isin(known), head).otherwise(F.lit(default))


def model_variant(spec: Column, known: list[str]) -> Column:
    head = F.split_part(spec, F.lit(":"), F.lit(1))
    return F.when(F.contains(spec, F.lit(":")) & head.isin(known), F.substr(spec, F.length(head) + 2)).otherwise(spec)


def file_ext(name: Column, default: str = ".model") -> Column:
    """Everything from the first dot after the first character of the file's own name."""
    own = F.element_at(F.split(name, "/"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(own, r"^.[^.]*(\..+)$", 1), F.lit("")), F.lit(default))


def pretty(key: Column) -> Column:
    return F.initcap(F.translate(key, "_-", "  "))


def cores(text: Column) -> Column:
    """Cores out of a pipe table with a column NCPUS or AllocCPUS, or out of a ``slots`` line."""
    rows = F.split(text, "\n")
    head = F.split(F.element_at(rows, 1), r"\|")
    at = F.greatest(F.array_position(head, "NCPUS"), F.array_position(head, "AllocCPUS"))
    table = F.when((at > 0) & (F.size(rows) > 1), F.try_element_at(F.split(F.try_element_at(rows, F.lit(2)), r"\|"), at.cast("int")).try_cast("int"))
    return F.coalesce(table, F.nullif(F.regexp_extract(text, r"slots\s+(\d+)", 1), F.lit("")).try_cast("int"))


def runtime(text: Column) -> Column:
    """Seconds out of [days-]hours:minutes:seconds."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"(?:(\d+)-)?(\d+):(\d\d):(\d\d)", i), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(text.rlike(r"\d+:\d\d:\d\d"), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))


def settings(text: Column) -> Column:
    """``NAME = value`` lines as a map; comments after # or ! are left out."""
    bare = F.filter(F.transform(F.split(text, "[\n;]"), lambda x: F.trim(F.regexp_replace(x, "[#!].*$", ""))), lambda x: F.contains(x, F.lit("=")))
    pair = lambda x: F.struct(F.upper(F.trim(F.split_part(x, F.lit("="), F.lit(1)))), F.trim(F.split_part(x, F.lit("="), F.lit(2))))
    return F.map_from_entries(F.transform(bare, pair))


def whole_seconds(c: Column) -> Column:
    """A span's text without its fraction."""
    return F.split_part(c.cast("string"), F.lit("."), F.lit(1))
