"""Scalar rules of structure records, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_null(c: Column | str) -> Column:
    """Trimmed text; empty becomes null."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def whole_or_null(c: Column | str) -> Column:
    return _c(c).try_cast("bigint")


def number_or_null(c: Column | str) -> Column:
    """A finite double, else null."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c))


def label(c: Column | str) -> Column:
    """A category in its plain form: trimmed, lower case, inner blanks as one underscore; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(_c(c))), r"[\s_]+", "_"), F.lit(""))


def struct_type(explicit: Column, flags: list[tuple[str, Column]], default: str = "unknown") -> Column:
    """The explicit type if there is one, else the name of the first true flag."""
    chain = F.when(text_or_null(explicit).isNotNull(), text_or_null(explicit))
    for name, flag in flags:
        chain = chain.when(flag, F.lit(name))
    return chain.otherwise(F.lit(default))


def flag_names(flags: list[tuple[str, Column]]) -> Column:
    """The names of the true flags, in their order, as a JSON array."""
    return F.to_json(F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags])))


def reasons(*parts: Column) -> Column:
    """Reasons in order, each once, separated by a comma and a blank; nulls left out."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ", ")


def modifications(c: Column | str) -> Column:
    """The names in a JSON array of text, in lower case; what is no such array lists nothing."""
    return F.coalesce(F.transform(F.regexp_extract_all(_c(c), F.lit('"([^"]+)"'), 1), lambda x: F.lower(x)), F.array().cast("array<string>"))


def composition(formula: Column | str) -> Column:
    """(element, count) pairs of a formula such as Ni25Ti7, in the order of elements; a missing count is one."""
    found = F.regexp_extract_all(_c(formula), F.lit(r"([A-Z][a-z]?)(\d*)"), 0)
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([A-Z][a-z]?)", 1).alias("element"), F.coalesce(F.regexp_extract(x, r"(\d+)$", 1).try_cast("int"), F.lit(1)).alias("count"))
    return F.array_sort(F.transform(found, pair))


def composition_key(formula: Column | str) -> Column:
    return F.array_join(F.transform(composition(formula), lambda p: F.concat(p["element"], F.lit(":"), p["count"].cast("string"))), ",")


def element_fraction(formula: Column | str, element: str) -> Column:
    """Share of the atoms that are of an element; zero if there are none."""
    parts = composition(formula)
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + p["count"])
    own = F.aggregate(F.filter(parts, lambda p: p["element"] == element), F.lit(0), lambda a, p: a + p["count"])
    return F.when(total > 0, own / total).otherwise(F.lit(0.0))


def in_range(share: Column, low: float, high: float, offset: float = 0.0) -> Column:
    """Strictly inside [low - offset, high + offset]; shares above one are percents."""
    x = F.when(share > 1, share / 100).otherwise(share)
    return (x > low - offset) & (x < high + offset)


def miller(c: Column | str) -> Column:
    """Three whole numbers out of any spelling of an index; (0, 0, 1) where there are none."""
    found = F.transform(F.regexp_extract_all(_c(c), F.lit(r"-?\d+"), 0), lambda x: x.cast("int"))
    return F.when(F.size(found) == 3, found).otherwise(F.array(F.lit(0), F.lit(0), F.lit(1)))


def miller_label(c: Column | str) -> Column:
    return F.translate(_c(c), "[](),'\" ", "")


def decay(step: Column, start: float, floor: float, rate: float) -> Column:
    return F.lit(floor) + F.lit(start - floor) * F.pow(F.lit(rate), step)


def relative_time(seconds: Column) -> Column:
    """A span in words."""
    s = seconds.cast("long")
    part = lambda n, w: F.concat((s / n).cast("long").cast("string"), F.lit(w))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, part(60, " min ago")).when(s < 86400, part(3600, " h ago")).otherwise(part(86400, " d ago"))


def parse_stamp(c: Column | str) -> Column:
    """A timestamp (UTC) from the ISO-8601 spellings the index holds; null if none fits."""
    t = F.regexp_replace(F.regexp_replace(_c(c), "T", " "), "(Z|\\+00:00)$", "")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
