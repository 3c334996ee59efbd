"""Every registered query with an oracle equals its DuckDB twin (sf0.001)."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE
from tools.oracle_check import TABLES, digest



@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def own(names):
    """Without the training-data queries, which have tests of their own."""
    return sorted(n for n in names if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", own(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


@pytest.mark.parametrize("name", own(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SMOKE).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
