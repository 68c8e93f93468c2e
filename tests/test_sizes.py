"""Summaries whose exact or distributed parts must not depend on the size of one task."""

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import summaries as sk
from cairnflow.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("low,high", [(0.4, 0.6), (0.05, 0.95), (0.25, 0.5), (0.0, 1.0)])
def test_within_ranks_equals_percentiles(spark, low, high):
    rows = [(k, v) for k, vs in {"a": [1.0, 2.0, 2.0, 3.0, 9.0], "b": [5.0] * 4, "c": [float(i % 7) for i in range(30)], None: [1.0, 2.0, 4.0]}.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double")
    exact = {r.k: (r.low, r.high) for r in df.groupBy("k").agg(F.percentile("v", low).alias("low"), F.percentile("v", high).alias("high")).collect()}
    for pick in (F.min("v"), F.max("v"), F.median("v").cast("int").cast("double"), F.max_by("v", F.col("v") % 3)):
        asked = df.groupBy("k").agg(pick.alias("x"))
        asked = asked.join(df.select(F.col("k").alias("_k"), F.col("v").alias("_v")).distinct(), F.col("k").eqNullSafe(F.col("_k")) & (F.col("x") == F.col("_v"))).select("k", "x")  # only values of the group
        want = {r.k: exact[r.k][0] <= r.x <= exact[r.k][1] for r in asked.collect()}
        assert {r.k: r.within for r in sk.within_ranks(df, "k", "v", asked, "x", low, high).collect()} == want


def test_kll_check_holds_no_percentile(spark):
    assert "percentile(" not in registry.queries()["sk_kll_median"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("task_rows", [50, 10**6])
def test_universal_state_is_the_same_for_any_tasks(spark, task_rows):
    df = spark.range(600, numPartitions=3).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), (F.col("id") * F.col("id") % 97).alias("i"))
    whole = {}
    for r in df.collect():
        whole[r.g, r.i] = whole.get((r.g, r.i), 0) + 1
    got = sk.universal(df, ["g"], "i", 4, 8, task_rows)
    assert got.groupBy("g", "level", "i").count().where("count > 1").count() == 0
    for g in ("a", None):
        top = sorted(((-n, i) for (k, i), n in whole.items() if k == g))[:8]
        assert sorted((-r.w, r.i) for r in got.where("level = 0").collect() if r.g == g) == top


def test_universal_counts_are_dealt_by_rows(spark):
    plan = sk.universal(spark.range(1000).selectExpr("'a' AS g", "id"), ["g"], "id", task_rows=100)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [id" in plan and ", 10" in plan
