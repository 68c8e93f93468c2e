"""Samples of one millisecond are read in the order of their microseconds, in whatever order the rows come."""

import pytest
from pyspark.sql import functions as F

from cairnflow.operators import timeseries as ts
from cairnflow.operators import views

#: Microseconds and a counter that rises throughout; the last three samples share a millisecond.
RISING = [(100_000, 1.0), (1_500_100, 2.0), (1_500_200, 5.0), (1_500_300, 9.0), (1_500_400, 20.0), (2_900_001, 30.0), (2_900_500, 31.0), (2_900_999, 40.0)]
AT = ts.Times(3000, 3000)


def counted(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "us long, value double").repartition(parts).select(F.lit("a").alias("x"), F.timestamp_micros("us").alias("at"), "value")
    return ts.series(df, "at", "value", ["x"])


def one(v):
    rows = v.df.collect()
    assert len(rows) == 1, rows
    return rows[0]["value"]


@pytest.mark.parametrize("rows,parts", [(RISING, 1), (RISING[::-1], 1), (RISING[4:] + RISING[:4], 3)])
def test_a_rising_counter_has_no_resets(spark, rows, parts):
    s = counted(spark, rows, parts)
    assert one(ts.over(s, "resets", AT, 3000)) == 0
    assert one(ts.over(s, "delta", AT, 3000)) == pytest.approx(39 * 3.0 / 2.8)
    assert one(ts.over(s, "increase", AT, 3000)) == pytest.approx(39 * (2.8 + 2.8 / 39 + 0.1) / 2.8)
    assert one(ts.over(s, "rate", AT, 3000)) == pytest.approx(13 * (2.8 + 2.8 / 39 + 0.1) / 2.8)
    assert one(ts.over(s, "idelta", AT, 3000)) == 9
    assert one(ts.over(s, "last", AT, 3000)) == one(ts.instant(s, AT, 3000)) == 40
    assert one(ts.over(s, "first", ts.Times(2000, 2000), 1000)) == 2
    assert {r.t: r.value for r in ts.over(s, "last", ts.Times(2000, 3000, 1000), 2000).df.collect()} == {2000: 20, 3000: 40}
    states = views.tumbling(s, 1000)
    assert one(views.sliding(states, ["x"], 1000, AT, 3000, "rise")) == 39
    assert one(views.sliding(states, ["x"], 1000, AT, 3000, "increase")) == pytest.approx(39 * (2.8 + 2.8 / 39 + 0.1) / 2.8)
    assert one(views.sliding(states, ["x"], 1000, AT, 3000, "rate")) == pytest.approx(13 * (2.8 + 2.8 / 39 + 0.1) / 2.8)
    assert [r.value for r in views.latest_per_series(s).collect()] == [40]


def test_irate_of_one_millisecond(spark):
    s = counted(spark, RISING[::-1])
    assert one(ts.over(s, "irate", AT, 3000)) == float("inf")
    assert one(views.sliding(views.tumbling(s, 1000), ["x"], 1000, AT, 3000, "irate")) == float("inf")


def test_samples_of_one_microsecond_count_from_the_smaller_value(spark):
    for rows in ([(100_000, 1.0), (900_000, 7.0), (900_000, 4.0)], [(900_000, 4.0), (900_000, 7.0), (100_000, 1.0)]):
        s = counted(spark, rows)
        assert one(ts.over(s, "resets", AT, 3000)) == 0
        assert one(views.sliding(views.tumbling(s, 1000), ["x"], 1000, AT, 3000, "rise")) == 6
