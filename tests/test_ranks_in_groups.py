"""Ranks in large groups against windows of a task for each group, with ties, nulls and NaN."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.operators import ordering


@pytest.mark.parametrize("rows,values,parts", [(0, 3, 5), (1, 3, 5), (300, 4, 9), (300, 60, 9), (300, 4, 1), (60, 1, 200)])
def test_ranks_in_groups(spark, rows, values, parts):
    r = random.Random(rows + values)
    number = lambda i: None if i % 17 == 3 else float("nan") if i % 19 == 5 else r.randrange(values) / 2
    data = [(r.choice("aab") if i % 11 else None, number(i), None if i % 13 == 4 else r.randrange(40), i) for i in range(rows)]
    df = spark.createDataFrame(data, "g string, x double, y long, id long")
    by = Window.partitionBy("g").orderBy(F.asc_nulls_first("x"))
    want = df.select("id", F.row_number().over(by.orderBy(*[F.asc_nulls_first(c) for c in ("x", "y", "id")])), F.rank().over(by), F.dense_rank().over(by)).collect()
    got = ordering.ranks_in_groups(df, ["g"], "x", ["y", "id"], parts, 5, 70).select("id", "row_number", "rank", "dense_rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_group_is_ranked_by_many_tasks(spark):
    from cairnflow.plans import registry

    df = registry.queries()["win_rank_family"](spark, "/root/testdata/sf0.001")
    assert "_place" in df._jdf.queryExecution().toString()  # ranges of the order, not the three flags, are what the windows partition by
    x = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") % 3).cast("double").alias("x"), F.col("id").alias("y"))
    got = ordering.ranks_in_groups(x, ["g"], "x", ["y"], 50, 24, 1000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(got) > 10 and max(r.n for r in got) < 5000
