"""Queries with a SQL twin give its rows; the small tables are whole."""

import duckdb
import pytest

from faresight.llm.queries import ORACLES, QUERIES
from tests.conftest import SMOKE
from tools.oracle_check import TABLES, digest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = QUERIES[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    columns, want = [d[0] for d in res.description], [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(columns, want)


def test_native_plan(spark):
    """The licence scan runs no Python on executors."""
    df = QUERIES["op2_licenses"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
