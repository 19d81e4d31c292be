"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


#: Training-data queries without SQL have tests of their own.
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() or not n.startswith(("op", "pipeline"))]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, SF, name)
    assert not result.startswith("FAIL"), result


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "split"
    assert {r["split"] for r in out.collect()} == {"train", "val", "test"}
