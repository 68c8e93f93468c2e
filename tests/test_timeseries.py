"""Hand-computed values of the time-series operators."""

import math

import pytest

from cairnflow.operators import timeseries as ts
from cairnflow.operators import views


def made(spark, rows, labels=("x",), stale=False):
    names = ", ".join(f"{n} string" for n in labels) + ", ts long, value double" + (", stale boolean" if stale else "")
    return ts.Series(spark.createDataFrame(rows, names), tuple(labels))


def value(v):
    rows = v.df.collect()
    assert len(rows) == 1, rows
    return rows[0]["value"]


def test_increase_and_rate_extrapolate(spark):
    s = made(spark, [("a", 60_000 + 15_000 * i, float(i + 1)) for i in range(17)])
    at = ts.Times(300_000, 300_000)
    assert value(ts.over(s, "increase", at, 300_000)) == pytest.approx(16.5)
    assert value(ts.over(s, "rate", at, 300_000)) == pytest.approx(0.055)
    s = made(spark, [("a", t * 1000, v) for t, v in ((180, 2.0), (240, 5.0), (270, 6.0), (300, 8.0))])
    assert value(ts.over(s, "increase", at, 300_000)) == pytest.approx(7)


def test_rate_counts_a_reset(spark):
    s = made(spark, [("a", 1, 2.0), ("a", 1000, 4.0), ("a", 2000, 2.0)])
    assert value(ts.over(s, "resets", ts.Times(2000, 2000), 2000)) == 1
    assert value(ts.over(s, "irate", ts.Times(2000, 2000), 2000)) == pytest.approx(2)


def test_window_is_open_on_the_left(spark):
    s = made(spark, [("a", 0, 1.0), ("a", 10, 2.0), ("a", 20, 4.0)])
    assert value(ts.over(s, "sum", ts.Times(20, 20), 20)) == 6
    assert value(ts.over(s, "sum", ts.Times(20, 20), 21)) == 7


def test_one_sample_has_no_rate(spark):
    assert ts.over(made(spark, [("a", 5, 1.0)]), "rate", ts.Times(10, 10), 10).df.count() == 0


def test_stale_marker_ends_a_series(spark):
    s = made(spark, [("a", 1, 1.0, False), ("a", 2, math.nan, True), ("b", 1, 3.0, False)], stale=True)
    assert [r["x"] for r in ts.instant(s, ts.Times(5, 5), 10).df.collect()] == ["b"]
    assert value(ts.over(ts.matching(s, ("x", "=", "a")), "count", ts.Times(5, 5), 10)) == 1


def test_nan_loses_against_numbers(spark):
    s = made(spark, [("a", 1, math.nan), ("a", 2, 1.0)])
    assert value(ts.over(s, "max", ts.Times(5, 5), 10)) == 1
    assert value(ts.over(s, "min", ts.Times(5, 5), 10)) == 1


def test_division_follows_ieee(spark):
    v = ts.Vector(spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.0), ("c", 0, -2.0)], "x string, t long, value double"), ("x",))
    got = {r["x"]: r["value"] for r in ts.with_scalar(v, "/", 0).df.collect()}
    assert got["a"] == math.inf and math.isnan(got["b"]) and got["c"] == -math.inf
    got = {r["x"]: r["value"] for r in ts.mapped(v, ts.POINTWISE["ln"]).df.collect()}
    assert got["a"] == 0 and got["b"] == -math.inf and math.isnan(got["c"])


def test_nan_is_unequal_to_itself(spark):
    v = ts.Vector(spark.createDataFrame([("a", 0, math.nan)], "x string, t long, value double"), ("x",))
    assert ts.with_scalar(v, "==", math.nan).df.count() == 0
    assert ts.with_scalar(v, "!=", math.nan).df.count() == 1


def test_many_series_on_the_one_side_fail(spark):
    v = ts.Vector(spark.createDataFrame([("a", "p", 0, 1.0), ("a", "q", 0, 2.0)], "x string, y string, t long, value double"), ("x", "y"))
    with pytest.raises(Exception, match="many series"):
        ts.binary(v, "+", v, on=["x"]).df.collect()
    one = ts.aggregate(v, "sum", by=["x"])
    assert sorted(r["value"] for r in ts.binary(v, "*", one, on=["x"], group="left").df.collect()) == [3, 6]


def test_smoothing(spark):
    s = made(spark, [("a", i, v) for i, v in enumerate([1.0, 2.0, 4.0], 1)])
    # s1 = 1, b1 = 1; s2 = .5*2 + .5*2 = 2, b2 stays 1 for the second sample; s3 = .5*4 + .5*3 = 3.5
    assert value(ts.over(s, "double_exponential_smoothing", ts.Times(5, 5), 10, sf=0.5, tf=0.5)) == pytest.approx(3.5)


def test_histogram_without_infinite_bucket_is_nan(spark):
    v = ts.Vector(spark.createDataFrame([("1", 0, 1.0), ("2", 0, 2.0)], "le string, t long, value double"), ("le",))
    assert math.isnan(value(ts.histogram_quantile(v, 0.5)))


def test_absent_and_scalar(spark):
    none = ts.Vector(spark.createDataFrame([], "x string, t long, value double"), ("x",))
    assert value(ts.absent(none, ts.Times(0, 0), {"x": "a"})) == 1
    assert math.isnan(value(ts.scalar(none, ts.Times(0, 0))))


def test_offset_and_fixed_time(spark):
    s = made(spark, [("a", 10, 1.0), ("a", 110, 5.0)])
    assert value(ts.instant(s, ts.Times(120, 120), 50, offset=100)) == 1
    assert [r["value"] for r in ts.instant(s, ts.Times(0, 20, 10), 50, at=120).df.collect()] == [5, 5, 5]


def test_window_states_merge_like_raw_samples(spark):
    s = made(spark, [("a", 7 * i, float(i * i % 13)) for i in range(200)])
    times = ts.Times(600, 1200, 200)
    for fn in ("sum", "count", "min", "max", "avg"):
        raw = {r["t"]: r["value"] for r in ts.over(s, fn, times, 400).df.collect()}
        assert {r["t"]: r["value"] for r in views.sliding(views.tumbling(s, 100), ("x",), 100, times, 400, fn).df.collect()} == pytest.approx(raw)
    with pytest.raises(ValueError):
        views.sliding(views.tumbling(s, 100), ("x",), 100, times, 450, "sum")


def test_view_store_reports_gaps(spark, tmp_path):
    s = made(spark, [("a", 7 * i, 1.0) for i in range(200)])
    store, states = views.ViewStore(str(tmp_path / "v")), views.tumbling(s, 100)
    store.append(states, 0, 500)
    store.append(states, 500, 1000)
    assert store.read(spark, 0, 1000).agg({"n": "sum"}).collect()[0][0] == sum(0 < 7 * i <= 1000 for i in range(200))
    with pytest.raises(ValueError, match="after 1000"):
        store.read(spark, 0, 1100)
    store.append(states, 400, 700)
    with pytest.raises(ValueError, match="two runs"):
        store.read(spark, 0, 1000)
    assert store.expire(spark, 500) == [0]
    with pytest.raises(ValueError, match="after 0"):
        store.read(spark, 0, 1000)


def test_certified_semi_join_fails_on_a_missing_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="no row"):
        views.certified_semi_join(left, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()


def test_registered_queries_read_all_events(spark):
    import os

    from pyspark.sql import functions as F

    from cairnflow.plans.series_queries import GRID, WINDOW

    data = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    first, last = spark.read.parquet(data).agg(F.min(at), F.max(at)).first()
    assert GRID.start - WINDOW < first and last <= GRID.end and GRID.step <= WINDOW


def test_scans_are_pruned_by_literal_times(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    s = ts.series(events, "ts", "value", ("event_type",))
    at = ts.Times(1_704_844_800_000, 1_704_844_800_000 + 7_200_000, 3_600_000)
    for fn in ("sum", "rate", "quantile"):
        plan = ts.over(s, fn, at, 3_600_000, **({"q": 0.5} if fn == "quantile" else {})).df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed, (fn, plan)


@pytest.mark.parametrize("fn", sorted(ts.MERGED))
def test_states_of_steps_equal_rows(spark, fn):
    rows = [(x, 37 * i % 1000, float(i * i % 17) if i % 9 else math.nan) for i in range(120) for x in "ab"]
    s = made(spark, rows)
    grid = ts.Times(50, 950, 100)
    got = {(r["x"], r["t"]): r["value"] for r in ts.over(s, fn, grid, 300, offset=20).df.collect()}
    want = {(r["x"], r["t"]): r["value"] for t in range(50, 951, 100) for r in ts.over(s, fn, ts.Times(t, t), 300, offset=20).df.collect()}
    assert got.keys() == want.keys()
    assert all(math.isnan(got[k]) and math.isnan(want[k]) or got[k] == pytest.approx(want[k]) for k in want)


def test_numbers_as_text(spark):
    values = [0.0, 1e-13, 2e-13, 0.1, 12.5, -3.0, 1e7, 123456789.25, 1e22, 5e-324, math.inf, -math.inf, math.nan, 1 / 3]
    df = spark.createDataFrame([(x,) for x in values], "value double")
    got = [r[0] for r in df.select(ts.number_text(df["value"])).collect()]
    assert got[:9] == ["0", "0.0000000000001", "0.0000000000002", "0.1", "12.5", "-3", "10000000", "123456789.25", "1" + "0" * 22]
    assert got[10:13] == ["+Inf", "-Inf", "NaN"] and all(float(t) == x for t, x in zip(got[:10], values[:10], strict=True)) and float(got[13]) == 1 / 3


def test_duplicate_result_series_fail(spark):
    many = ts.Vector(spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 1, 2.0)], "k string, h string, t long, value double"), ("k", "h"))
    one = ts.Vector(spark.createDataFrame([("a", "z", 1, 2.0)], "k string, h string, t long, value double"), ("k", "h"))
    with pytest.raises(Exception, match="result"):
        ts.binary(many, "*", one, on=["k"], group="left", include=["h"]).df.collect()
