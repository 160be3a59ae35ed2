"""The problems' queries run on the smallest tables and give the columns that are stated."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from latticework import llm

COLUMNS = {"p2_found": ["split_name", "id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p8_found": ["doc_id"]}
NAMES = sorted(k for m in llm.query_modules() for k in m.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows)
    assert df.columns == COLUMNS.get(name, df.columns)
