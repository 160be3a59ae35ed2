"""Spelling of structure ids.

An id is compared by its ASCII letters and digits alone, ignoring case. Nothing left, or only
a word for "no value", is no reference. Written out, a 32-character id is hyphenated 8-4-4-4-12.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a writer puts where there is no id.
NO_VALUE = ("", "none", "nan", "na", "null")


def id_key(c: Column | str) -> Column:
    """The comparable form of an id; null if it is no reference."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(~bare.isin(*NO_VALUE), bare)


def id_text(key: Column | str) -> Column:
    """A key written out; a key of another length than 32 stays as it is."""
    key = F.col(key) if isinstance(key, str) else key
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(key) == 32, F.concat_ws("-", *parts)).otherwise(key)


#: The same two rules in SQL, for oracles.
SQL_KEY = "nullif(nullif(nullif(nullif(nullif(lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')), ''), 'none'), 'nan'), 'na'), 'null')"
SQL_TEXT = "case when length({k}) = 32 then substr({k},1,8)||'-'||substr({k},9,4)||'-'||substr({k},13,4)||'-'||substr({k},17,4)||'-'||substr({k},21,12) else {k} end"
