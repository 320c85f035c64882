"""Every registered query: runs, equals its SQL, and has a plan without nested-loop joins."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

from tools.check import TABLES, normal  # noqa: E402

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def sql(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoopJoin|CartesianProduct", plan)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in entry.oracle_sql():
        cur = sql.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(cur.fetchall(), cols)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["n", "pearson_r", "slope", "intercept"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)
