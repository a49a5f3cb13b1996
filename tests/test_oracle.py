"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison on sf0.01)."""

import math
import re

import pytest

import __spark_entry__ as E
from conftest import SMALL_SF

# the training-data queries have tests of their own
OWN_TESTS = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: f for k, f in E.queries().items() if not OWN_TESTS.match(k)}
SQL = {k: q for k, q in E.oracle_sql().items() if not OWN_TESTS.match(k)}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SMALL_SF)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[key])
    assert sorted(df.columns) == sorted(rel.columns)
    orows = rel.fetchall()
    assert len(rows) == len(orows)
    assert _canon(rows, df.columns) == _canon(orows, rel.columns)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, key):
    df = QUERIES[key](spark, SMALL_SF)
    assert df.count() >= 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["step", "metric", "value"]
