"""Every registered query of the relational, time-series and summary parts against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairnflow.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.6g}" if abs(x) < 2**40 else str(x)
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in columns]).collect())
    r = duck.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in r.description].index(c) for c in columns]
    want = sorted([plain(row[i]) for i in order] for row in r.fetchall())
    assert got == want


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, DATA).count() >= 0, name


def test_same_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
