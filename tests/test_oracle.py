"""Every registered query against its DuckDB twin (sf0.001 here; the driver
runs the same comparison at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, norm
from sitewatch.plans.queries import QUERIES as SITE_QUERIES

SF = os.environ.get("SITEWATCH_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(SITE_QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["project_id", "document"]
    assert df.count() >= 0


def test_every_query_has_oracle():
    missing = [n for n in NAMES if n not in E.oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    so = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert sorted(tuple(norm(r[i]) for i in so) for r in srows) == sorted(tuple(norm(r[i]) for i in do) for r in drows)
