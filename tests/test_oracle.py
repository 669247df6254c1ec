"""Every catalogue query against its DuckDB SQL on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402
from riskvq.plans.catalog import QUERIES  # noqa: E402
from riskvq.plans.oracle import ORACLE_SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# A serial program over a bag; tests/test_training.py compares it with a plain loop.
NO_SQL = {"bvq_train_online"}


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_matches_sql(spark, con, name):
    ok, msg, _, _ = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["actual", "predicted", "n"]
    assert df.count() > 0
