"""Every query runs on the smallest tables; those with a SQL twin give the same rows as DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from verify import compare

#: Without a SQL twin: eigenvalues, triangulations and lattice arithmetic. Their rules have one (vendi_rules, hull_rules, cluster_sizes), and tests check the operators by brute force.
NO_TWIN = {"cluster_atoms", "concave_hull", "diversity_growth", "optimised_hull", "slabs", "vendi_by_label", "vendi_subsampled"}
CORE = sorted({k for m in entry._modules() if not m.__name__.startswith("latticework.llm") for k in m.QUERIES})


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    told = compare(spark, con, name, SMALL)
    if name in NO_TWIN:
        assert told.startswith("rows") and not told.startswith("rows 0 ")
    else:
        assert told.startswith("ok"), told


def test_entry(spark, small):
    assert entry.entry(spark).columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/latticework/**/*.py", recursive=True):
        if "/llm/" not in f:
            with open(f) as h:
                assert "latticework.llm" not in h.read() and "latticework import llm" not in open(f).read(), f
