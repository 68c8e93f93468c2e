"""Ranks over all rows and as-of joins against windows of one task and loops, with ties, nulls, hot keys and empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.functions import extensions
from cairnflow.operators import ordering
from cairnflow.operators import timeseries as ts


@pytest.mark.parametrize("rows,tiles,parts", [(0, 4, 5), (1, 4, 5), (3, 5, 4), (200, 7, 9), (200, 4, 1)])
def test_global_ranks(spark, rows, tiles, parts):
    r = random.Random(rows)
    data = [(i, None if i % 17 == 3 else float(r.randrange(40) if i % 3 else 7)) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, x double")
    w = Window.orderBy(F.asc_nulls_first("x"), "id")
    want = df.select("id", F.row_number().over(w), F.ntile(tiles).over(w), F.percent_rank().over(w), F.cume_dist().over(w)).collect()
    got = ordering.global_ranks(df, "x", ["id"], tiles, parts).select("id", "row_number", "ntile", "percent_rank", "cume_dist").collect()
    assert sorted(tuple(round(v, 9) for v in x) for x in got) == sorted(tuple(round(v, 9) for v in x) for x in want)


@pytest.mark.parametrize("bucket", [1, 60, 10**9])
def test_asof(spark, bucket):
    r = random.Random(5)
    key = lambda: r.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(i, key(), None if i % 29 == 0 else r.randrange(300)) for i in range(150)]
    right = [(i, key(), None if i % 23 == 0 else r.randrange(300)) for i in range(100)]
    shape = lambda rows: spark.createDataFrame(rows, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("t"))
    got = ordering.asof(shape(left), shape(right), ["k"], "t", ["id"], "id", bucket)
    want = []
    for i, k, s in left:
        fit = [(b, j) for j, x, b in right if x == k and k is not None and s is not None and b is not None and b < s]
        want.append((i, max(fit)[1] if fit else None))
    assert sorted((x["id"], x["id_right"]) for x in got.collect()) == sorted(want)


def test_asof_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "a")], "id long, k string").withColumn("t", F.timestamp_seconds(F.lit(5)))
    assert ordering.asof(some.limit(0), some, ["k"], "t", ["id"], "id").count() == 0
    assert [x["id_right"] for x in ordering.asof(some, some.limit(0), ["k"], "t", ["id"], "id").collect()] == [None]


def test_extensions(spark):
    with pytest.raises(ValueError):
        extensions.register("geometric_mean", F.sum)
    with pytest.raises(ValueError):
        extensions.call("nothing", "x")
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (2, None)], "k int, x double")
    assert sorted((r.k, r.g) for r in extensions.aggregate(df, ["k"], g=("geometric_mean", "x")).where("k = 1").collect()) == [(1, pytest.approx(4.0))]


def test_metric_kinds(spark):
    df = spark.createDataFrame([("a", 1.0)], "l string, v double").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    at = ts.Times(10_000, 10_000)
    with pytest.warns(ts.MetricKindWarning):
        ts.over(ts.matching(ts.series(df, "ts", "v", ["l"], "gauge"), ("l", "=", "a")), "rate", at, 10_000)
    with pytest.raises(ValueError):
        ts.over(ts.series(df, "ts", "v", ["l"], "native_histogram"), "sum", at, 10_000)
    assert [r.value for r in ts.over(ts.series(df, "ts", "v", ["l"], "gauge"), "default_rollup", at, 10_000).df.collect()] == [1.0]
    with pytest.raises(ValueError):
        ts.over_groups(df, [], ["l", "ts"], "ts", "v", "rate", 1000, 10_000)
