"""Column functions over several partitions."""

import math

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import shims


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_correlation_of_a_constant_in_several_partitions(spark, parts):
    # the mean of 49 ones, merged into an empty state, isn't one
    df = spark.range(49 * parts, numPartitions=parts).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
    r = df.agg(shims.correlation(F.col("x"), F.col("one")).alias("a"), shims.correlation(F.col("one"), F.col("x")).alias("b"), shims.correlation(F.col("x"), F.col("x")).alias("c")).first()
    assert (r.a, r.b) == (None, None) and r.c == pytest.approx(1)


def test_correlation_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 5.0), (3.0, 7.0), (4.0, 3.0)], "x double, y double")
    assert df.agg(shims.correlation(F.col("x"), F.col("y")).alias("r")).first().r == pytest.approx(0.37115374447904514)
    assert df.where("x = 2").agg(shims.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None
    odd = df.select("x", F.lit(float("nan")).alias("y")).where("x IS NOT NULL")
    assert math.isnan(odd.agg(shims.correlation(F.col("x"), F.col("y")).alias("r")).first().r)
