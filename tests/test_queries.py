"""The key-set queries against their SQL."""

import os

import duckdb
import pytest

from ordkeys import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query_equals_sql(spark, db, name):
    got = plans.queries()[name](spark, DATA)
    want = db.sql(plans.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, rows))


def test_ranges_are_pushed_to_saved_sets(spark):
    plan = plans.queries()["saved_prefix_enum"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
