"""Time-series operators over DataFrames, with the semantics of PromQL and MetricsQL expressions.

A Series holds raw samples: label columns, `ts` (milliseconds), `value`, and if it has any, a boolean `stale`. Samples of one
millisecond are told apart by `us` (microseconds), if the series has it: in no other order are they read.
A Vector holds results: label columns, `t` (evaluation time in milliseconds), `value`. An absent label is an empty
string or null. All evaluation times of a range query are computed in one plan: a sample is assigned to the
times whose left-open window (t - w, t] holds it by arithmetic on its timestamp, not by a join.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Series:
    df: DataFrame
    labels: tuple[str, ...]
    kind: str = ""  # counter, gauge, histogram or native_histogram; empty: not known


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Times:
    """Evaluation times start, start + step, ..., end; one time if end is start."""

    start: int
    end: int
    step: int = 1

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.range(self.last + 1).select((F.col("id") * self.step + self.start).alias("t"))


def series(df: DataFrame, ts: str, value: str | Column, labels: Sequence[str], kind: str = "") -> Series:
    """Samples of a table; timestamps are cut to milliseconds. kind: the metric's type, if it is known."""
    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000)
    more = [F.col("stale")] if "stale" in df.columns else []
    more.append(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return Series(df.select(*labels, ms.alias("ts"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"), *more, F.col(ts).alias("raw_ts")), tuple(labels), kind)


def between(s: Series, after: int, until: int) -> Series:
    """Samples in (after, until]. The table's own timestamps are compared with literals, so the scan reads no other row groups."""
    df = s.df
    if "raw_ts" in df.columns:
        kind = df.schema["raw_ts"].dataType.simpleString()
        slack = 0 if kind == "timestamp" else 26 * 3_600_000  # local times may be off by a zone and an hour
        bound = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
        df = df.where((F.col("raw_ts") >= bound(after + 1 - slack)) & (F.col("raw_ts") < bound(until + 1 + slack))).drop("raw_ts")
    return replace(s, df=df.where((F.col("ts") > after) & (F.col("ts") <= until)))


def moment(df: DataFrame) -> str:
    """The column that orders samples."""
    return "us" if "us" in df.columns else "ts"


def matching(s: Series, *matchers: tuple[str, str, str]) -> Series:
    """Samples whose labels meet (label, =, !=, =~ or !~, text); patterns are anchored and `.` meets line ends."""
    df = s.df
    for label, op, text in matchers:
        have = F.coalesce(F.col(label).cast("string"), F.lit(""))
        hit = have == text if op in ("=", "!=") else have.rlike(f"^(?s:{text})$")
        df = df.where(hit if op in ("=", "=~") else ~hit)
    return replace(s, df=df)


#: Functions that read a counter's rises, and those that read a gauge's values.
COUNTER_FUNCTIONS = ("rate", "increase", "irate", "resets")
GAUGE_FUNCTIONS = ("delta", "idelta", "deriv", "predict_linear", "double_exponential_smoothing")


class MetricKindWarning(UserWarning):
    """A function was asked of a metric of another kind; its result is given all the same."""


def check_kind(s: Series, fn: str) -> None:
    """Refuses native histograms and warns where a function doesn't suit the metric's kind. Nothing is said of unknown kinds."""
    if s.kind == "native_histogram":
        raise ValueError(f"{fn}: native histograms aren't read; give their classic buckets")
    if s.kind == "gauge" and fn in COUNTER_FUNCTIONS or s.kind == "counter" and fn in GAUGE_FUNCTIONS:
        warnings.warn(f"{fn} is for a {'counter' if s.kind == 'gauge' else 'gauge'}, the metric is a {s.kind}", MetricKindWarning, stacklevel=3)


# IEEE arithmetic, where Spark's ANSI mode raises errors and its NaN equals itself.


def divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b != 0, a / F.when(b == 0, F.lit(1.0)).otherwise(b)).otherwise(zero)


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def logarithm(f, x: Column) -> Column:
    return F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": F.pow, "atan2": F.atan2}
_NUMBERS = lambda a, b: ~(F.isnan(a) | F.isnan(b))
COMPARE = {
    "==": lambda a, b: _NUMBERS(a, b) & (a == b), "!=": lambda a, b: ~_NUMBERS(a, b) | (a != b), "<": lambda a, b: _NUMBERS(a, b) & (a < b),
    "<=": lambda a, b: _NUMBERS(a, b) & (a <= b), ">": lambda a, b: _NUMBERS(a, b) & (a > b), ">=": lambda a, b: _NUMBERS(a, b) & (a >= b),
}


def least_number(x: Column) -> Column:
    """Minimum to which NaN is the last resort."""
    return F.coalesce(F.min(F.when(~F.isnan(x), x)), F.min(x))


def greatest_number(x: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))


# Selectors


def windows(s: Series, times: Times, window: int, offset: int = 0) -> DataFrame:
    """Each sample once per evaluation time t with ts in (t - offset - window, t - offset], with `t` and `open` (the excluded start)."""
    first = F.greatest(F.ceil((F.col("ts") + offset - times.start) / times.step), F.lit(0))
    last = F.least(F.ceil((F.col("ts") + (offset + window - times.start)) / times.step) - 1, F.lit(times.last))
    near = between(s, times.start - offset - window, times.end - offset).df
    steps = near.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = F.col("k") * times.step + times.start
    return steps.withColumn("t", t).withColumn("open", t - offset - window).drop("k")


def instant(s: Series, times: Times, lookback: int, offset: int = 0, at: int | None = None) -> Vector:
    """Latest sample per series in the lookback; none if that sample is stale."""
    if at is not None:
        return _spread(instant(s, Times(at, at), lookback, offset), times)
    w = windows(s, times, lookback, offset)
    stale = F.col("stale") if "stale" in s.df.columns else F.lit(False)
    got = w.groupBy(*s.labels, "t").agg(F.max_by(F.struct("value", stale.alias("stale")), moment(w)).alias("_last"))
    return Vector(got.where(~F.col("_last.stale")).select(*s.labels, "t", F.col("_last.value").alias("value")), s.labels)


def _spread(v: Vector, times: Times) -> Vector:
    """A vector evaluated at one fixed time, at all times."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(times.last)), lambda k: k.cast("long") * F.lit(times.step) + F.lit(times.start))
    return Vector(v.df.drop("t").withColumn("t", F.explode(F.transform(steps, lambda t: t.cast("long")))).select(*v.labels, "t", "value"), v.labels)


def extrapolated(kind: str, window: int, change: Column) -> Column:
    """rate, increase or delta from n, ft, lt and fv of a window and the change in it, extrapolated to its ends."""
    counter = kind != "delta"
    span = (F.col("lt") - F.col("ft")) / 1000
    each = span / F.greatest(F.col("n") - 1, F.lit(1))
    before, after = (F.col("ft") - F.col("open")) / 1000, (F.col("open") + window - F.col("lt")) / 1000
    before, after = (F.when(x >= each * 1.1, each / 2).otherwise(x) for x in (before, after))
    if counter:  # a counter can't have been below zero
        before = F.when((change > 0) & (F.col("fv") >= 0), F.least(before, span * F.col("fv") / change)).otherwise(before)
    whole = change * (span + before + after) / span
    out = whole / (window / 1000) if kind == "rate" else whole
    return F.when((F.col("n") >= 2) & (F.col("lt") > F.col("ft")), out)


def _smoothing(sf: float, tf: float, at: Column) -> Column:
    """Double exponential smoothing over the values, sorted by `at`."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(at, "value"))), lambda x: x["value"])
    start = F.struct(F.element_at(v, 1).alias("s"), (F.element_at(v, 2) - F.element_at(v, 1)).alias("b"))

    def step(acc, x):
        s = sf * x + (1 - sf) * (acc["s"] + acc["b"])
        return F.struct(s.alias("s"), (tf * (s - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))

    first = F.struct((sf * F.element_at(v, 2) + (1 - sf) * (F.element_at(v, 1) + start["b"])).alias("s"), start["b"].alias("b"))
    rest = F.aggregate(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), first, step, lambda acc: acc["s"])
    return F.when(F.count("*") >= 2, rest)


def over(s: Series, fn: str, times: Times, window: int, offset: int = 0, at: int | None = None, **args: float) -> Vector:
    """A range function per series and evaluation time. Series without an answer are left out."""
    check_kind(s, fn)
    fn = {"default_rollup": "last"}.get(fn, fn)
    s = replace(s, kind="")
    if at is not None:
        return _spread(over(s, fn, Times(at, at), window, offset, **args), times)
    if "stale" in s.df.columns:
        s = Series(s.df.where(~F.col("stale")).drop("stale"), s.labels)
    s = between(s, times.start - offset - window, times.end - offset)  # a sample before all windows is no predecessor in any
    if fn in MERGED and times.last and window % times.step == 0 and window > times.step:
        return _from_steps(s, fn, times, window, offset)
    by_series = Window.partitionBy(*s.labels).orderBy(moment(s.df), "value")  # of samples of one moment the smaller value is the first
    order = F.col(moment(s.df))
    paired = fn in ("rate", "increase", "irate", "idelta", "changes", "resets")
    if paired:
        s = Series(s.df.withColumn("pv", F.lag("value").over(by_series)).withColumn("pt", F.lag("ts").over(by_series)).withColumn("_at", F.row_number().over(by_series)), s.labels)
        order = F.col("_at")
    w = windows(s, times, window, offset)
    v, ts = F.col("value"), F.col("ts")
    if paired:
        inside = F.col("pt") > F.col("open")
        before = F.when(inside, F.col("pv"))
    keys = [*s.labels, "t"]
    if fn in ("rate", "increase", "delta"):
        drop = F.sum(F.when(v < before, before).otherwise(0.0)) if fn != "delta" else F.lit(0.0)
        g = w.groupBy(*keys, "open").agg(F.count("*").alias("n"), F.min("ts").alias("ft"), F.max("ts").alias("lt"), F.min_by("value", order).alias("fv"), F.max_by("value", order).alias("lv"), drop.alias("resets"))
        got = g.select(*keys, extrapolated(fn, window, F.col("lv") - F.col("fv") + F.col("resets")).alias("value"))
    elif fn in ("distinct", "entropy", "l2"):
        c = w.groupBy(*keys, "value").agg(F.count("*").cast("double").alias("c"))
        value = {"distinct": F.count("*").cast("double"), "entropy": F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), "l2": F.sqrt(F.sum(F.col("c") * F.col("c")))}[fn]
        got = c.groupBy(*keys).agg(value.alias("value"))
    elif fn == "mad":
        m = w.groupBy(*keys).agg(F.percentile("value", 0.5).alias("m"))
        got = w.join(m, keys).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("m")), 0.5).alias("value"))
    else:
        got = w.groupBy(*keys).agg(_range_value(fn, v, ts, order, before if paired else None, offset, args).alias("value"))
    return Vector(got.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value")), s.labels)


#: Range functions of states that merge: what a step's state holds, and how a window reads it.
MERGED = {
    "sum": (lambda v, ts: {"a": F.sum(v)}, lambda: F.sum("a")),
    "count": (lambda v, ts: {"a": F.count("*").cast("double")}, lambda: F.sum("a")),
    "avg": (lambda v, ts: {"a": F.sum(v), "n": F.count("*")}, lambda: F.sum("a") / F.sum("n")),
    "min": (lambda v, ts: {"a": least_number(v)}, lambda: least_number(F.col("a"))),
    "max": (lambda v, ts: {"a": greatest_number(v)}, lambda: greatest_number(F.col("a"))),
    "present": (lambda v, ts: {"a": F.lit(1.0)}, lambda: F.max("a")),
    "last": (lambda v, at: {"a": F.max_by(v, at), "at": F.max(at)}, lambda: F.max_by("a", "at")),
    "first": (lambda v, at: {"a": F.min_by(v, at), "at": F.min(at)}, lambda: F.min_by("a", "at")),
    "ts_of_first": (lambda v, ts: {"a": F.min(ts)}, lambda: F.min("a") / 1000),
    "ts_of_last": (lambda v, ts: {"a": F.max(ts)}, lambda: F.max("a") / 1000),
}


def _from_steps(s: Series, fn: str, times: Times, window: int, offset: int) -> Vector:
    """A range function over states of single steps: a row is read once, and states, not rows, go to all windows they are in."""
    state, read = MERGED[fn]
    step = F.ceil((F.col("ts") + offset - times.start) / times.step)  # the first evaluation whose window holds the sample
    steps = s.df.withColumn("_k", step).groupBy(*s.labels, "_k").agg(*[c.alias(n) for n, c in state(F.col("value"), F.col(moment(s.df) if fn in ("last", "first") else "ts")).items()])
    first, last = F.greatest(F.col("_k"), F.lit(0)), F.least(F.col("_k") + (window // times.step - 1), F.lit(times.last))
    spread = steps.where(first <= last).withColumn("_at", F.explode(F.sequence(first, last))).withColumn("t", F.col("_at") * times.step + times.start)
    got = spread.groupBy(*s.labels, "t").agg(read().alias("value"))
    return Vector(got.where(F.col("value").isNotNull()).select(*s.labels, "t", F.col("value").cast("double").alias("value")), s.labels)


def _range_value(fn: str, v: Column, ts: Column, at: Column, before: Column | None, offset: int, args: dict) -> Column:
    latest = F.max_by(F.struct(v.alias("v"), before.alias("p"), ts.alias("ts"), F.col("pt")), at) if before is not None else None
    x = (ts - F.col("t") + offset) / 1000.0  # seconds from the evaluation time
    if fn == "irate":
        rise = F.when(latest["v"] < latest["p"], latest["v"]).otherwise(latest["v"] - latest["p"])
        return F.when(latest["p"].isNotNull(), divide(rise, (latest["ts"] - latest["pt"]) / 1000))
    if fn == "idelta":
        return latest["v"] - latest["p"]
    if fn == "changes":
        return F.count_if(before.isNotNull() & (v != before) & ~(F.isnan(v) & F.isnan(before))).cast("double")
    if fn == "resets":
        return F.count_if(v < before).cast("double")
    if fn == "deriv":
        return F.when((F.count("*") >= 2) & (F.var_pop(x) > 0), F.when(F.max(v) == F.min(v), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(v, x), F.var_pop(x))))
    if fn == "predict_linear":
        slope = F.when(F.max(v) == F.min(v), F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(v, x), F.var_pop(x)))
        return F.when((F.count("*") >= 2) & (F.var_pop(x) > 0), F.avg(v) - slope * F.avg(x) + slope * args["ahead"])
    if fn == "double_exponential_smoothing":
        if not (0 < args["sf"] < 1 and 0 < args["tf"] < 1):
            raise ValueError("factors lie between 0 and 1")
        return _smoothing(args["sf"], args["tf"], at)
    if fn == "quantile":
        return _quantile(args["q"], v)
    number = F.when(F.isnan(v), F.lit(0)).otherwise(F.lit(1))
    simple = {
        "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count("*"), "min": lambda: least_number(v), "max": lambda: greatest_number(v),
        "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v), "last": lambda: F.max_by(v, at), "first": lambda: F.min_by(v, at), "present": lambda: F.lit(1.0),
        "ts_of_min": lambda: F.min_by(ts, F.struct(1 - number, v, -ts)) / 1000, "ts_of_max": lambda: F.max_by(ts, F.struct(number, v, ts)) / 1000,
        "ts_of_first": lambda: F.min(ts) / 1000, "ts_of_last": lambda: F.max(ts) / 1000,
    }
    return simple[fn]()


def _quantile(q: float, v: Column) -> Column:
    if q != q:
        return F.max(F.lit(NAN))
    return F.max(F.lit(-INF)) if q < 0 else F.max(F.lit(INF)) if q > 1 else F.percentile(v, q)


def subquery(v: Vector) -> Series:
    """A vector's evaluations as samples, to range over: evaluate it at multiples of the resolution first."""
    return Series(v.df.withColumnRenamed("t", "ts"), v.labels)


# Functions of vectors


def mapped(v: Vector, f) -> Vector:
    """A pointwise function of the value."""
    return Vector(v.df.withColumn("value", f(F.col("value")).cast("double")), v.labels)


def _clamp(low: float, high: float):
    return lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamp(v: Vector, low: float, high: float) -> Vector:
    """No rows if the bounds are crossed."""
    return mapped(v if low <= high else Vector(v.df.where(F.lit(False)), v.labels), _clamp(low, high))


def whole(f):
    """ceil or floor as doubles: numbers that are whole or none stay as they are."""
    near = lambda x: f(F.when(F.abs(x) < 2.0**53, x)).cast("double")
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**53) | (x == 0), x).when((x < 0) & (near(x) == 0), F.lit(-0.0)).otherwise(near(x))


def rounded(v: Vector, to: float = 1.0) -> Vector:
    """To the nearest multiple, halves up."""
    return mapped(v, lambda x: whole(F.floor)(divide(x, F.lit(to)) + 0.5) * to)


def _calendar(f):
    """A part of the UTC time that the value gives in seconds; NaN of NaN and of times that no calendar has."""
    far = lambda x: F.isnan(x) | (F.abs(x) > 2.5e11)
    utc = lambda x: F.to_utc_timestamp(F.timestamp_seconds(F.floor(x)), F.current_timezone())
    return lambda x: F.when(far(x), F.lit(NAN)).otherwise(f(utc(F.when(far(x), F.lit(0.0)).otherwise(x))).cast("double"))


POINTWISE = {
    "abs": F.abs, "ceil": whole(F.ceil), "floor": whole(F.floor), "round": lambda x: whole(F.floor)(x + 0.5), "exp": F.exp, "ln": lambda x: logarithm(F.ln, x), "log2": lambda x: logarithm(F.log2, x), "log10": lambda x: logarithm(F.log10, x),
    "sqrt": lambda x: F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x)), "sgn": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians,
    "minute": _calendar(F.minute), "hour": _calendar(F.hour), "day_of_week": _calendar(lambda x: F.dayofweek(x) - 1), "day_of_month": _calendar(F.dayofmonth), "day_of_year": _calendar(F.dayofyear),
    "month": _calendar(F.month), "year": _calendar(F.year), "days_in_month": _calendar(lambda x: F.dayofmonth(F.last_day(x))),
}


def kept_labels(v: Vector, by: Sequence[str] | None, without: Sequence[str] | None) -> tuple[str, ...]:
    if by is not None:
        return tuple(x for x in by if x in v.labels)
    return tuple(x for x in v.labels if without is not None and x not in without)


def aggregate(v: Vector, op: str, by: Sequence[str] | None = None, without: Sequence[str] | None = None, q: float = 0.5) -> Vector:
    """sum, avg, min, max, count, group, stddev, stdvar or quantile across series; neither by nor without: over all."""
    keys, x = kept_labels(v, by, without), F.col("value")
    f = {"sum": F.sum, "avg": F.avg, "min": least_number, "max": greatest_number, "count": lambda c: F.count("*"), "group": lambda c: F.max(F.lit(1.0)), "stddev": F.stddev_pop, "stdvar": F.var_pop, "quantile": lambda c: _quantile(q, c)}[op]
    return Vector(v.df.groupBy(*keys, "t").agg(f(x).cast("double").alias("value")), keys)


def number_text(x: Column) -> Column:
    """The shortest text that reads back as x, without an exponent."""
    plain = F.regexp_replace(F.abs(x).cast("string"), r"\.0(?=E|$)", "")
    digits = F.translate(F.regexp_extract(plain, "^[0-9.]+", 0), ".", "")
    e = F.regexp_extract(plain, r"E(-?\d+)$", 1)
    power = F.when(e != "", e.cast("int")).otherwise(F.lit(0))
    point = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.when(point <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, point)))
    body = F.when(e == "", plain).when(power < 0, small).otherwise(large)
    signed = F.concat(F.when(F.substring(x.cast("string"), 1, 1) == "-", F.lit("-")).otherwise(F.lit("")), body)
    return F.when(F.isnan(x), F.lit("NaN")).when(x == INF, F.lit("+Inf")).when(x == -INF, F.lit("-Inf")).otherwise(signed)


def count_values(v: Vector, label: str, by: Sequence[str] = ()) -> Vector:
    """How many series have each value, which becomes a label."""
    return Vector(v.df.withColumn(label, number_text(F.col("value"))).groupBy(*by, label, "t").agg(F.count("*").cast("double").alias("value")), (*by, label))


def ranked(v: Vector, op: str, k: int, by: Sequence[str] = ()) -> Vector:
    """topk, bottomk or limitk per group and time; series keep their labels. Ties go by labels, NaN last."""
    if k < 1:
        return Vector(v.df.where(F.lit(False)), v.labels)
    labels = [F.col(x).asc_nulls_first() for x in v.labels]
    order = {"topk": [F.isnan("value"), F.desc("value")], "bottomk": [F.isnan("value"), F.asc("value")], "limitk": []}[op]
    w = Window.partitionBy(*by, "t").orderBy(*order, *labels)
    return Vector(v.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), v.labels)


def limit_ratio(v: Vector, ratio: float) -> Vector:
    """A share of the series, the same ones at any time, by a hash of their labels; a negative ratio gives the rest."""
    text = [F.concat(F.lit(f"{x}\x00"), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("\x00")) for x in sorted(v.labels)]
    place = (F.xxhash64(*text).cast("double") + 2.0**63) / 2.0**64
    return Vector(v.df.where(place < ratio if ratio >= 0 else place >= 1 + ratio), v.labels)


def with_scalar(v: Vector, op: str, x: float, flipped: bool = False, as_bool: bool = False) -> Vector:
    """Vector and number; a comparison filters unless as_bool. flipped: the number stands left."""
    a, b = F.col("value"), F.lit(float(x))
    a, b = (b, a) if flipped else (a, b)
    if op in ARITHMETIC:
        return Vector(v.df.withColumn("value", ARITHMETIC[op](a, b)), v.labels)
    hit = COMPARE[op](a, b)
    return Vector(v.df.withColumn("value", hit.cast("double")) if as_bool else v.df.where(hit), v.labels)


def _signature(a: Vector, b: Vector, on: Sequence[str] | None, ignoring: Sequence[str] | None) -> tuple[str, ...]:
    if on is not None:
        return tuple(on)
    names = dict.fromkeys((*a.labels, *b.labels))
    return tuple(x for x in names if x not in (ignoring or ()))


def _with_labels(v: Vector, names: Sequence[str]) -> DataFrame:
    df = v.df
    for x in names:
        df = df.withColumn(x, F.coalesce(F.col(x), F.lit("")) if x in v.labels else F.lit(""))
    return df


def _unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Fails when it is read if two series of a side have one signature."""
    n = F.count("*").over(Window.partitionBy(*keys, "t"))
    return df.withColumn("value", F.when(n > 1, F.raise_error(F.lit(f"many series match on the {side} side")).cast("double")).otherwise(F.col("value")))


def binary(a: Vector, op: str, b: Vector, on: Sequence[str] | None = None, ignoring: Sequence[str] | None = None, group: str | None = None, include: Sequence[str] = (), as_bool: bool = False) -> Vector:
    """Matched by equal signatures. group: left or right, the side that may have many series; include: labels it takes from the one side."""
    keys = _signature(a, b, on, ignoring)
    left, right = _with_labels(a, keys), _with_labels(b, keys)
    if group != "left":
        left = _unique(left, keys, "left")
    if group != "right":
        right = _unique(right, keys, "right")
    many, one = (b, a) if group == "right" else (a, b)
    labels = tuple(dict.fromkeys((*many.labels, *include))) if group else keys
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    joined = l.join(r, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "t")])
    side = "r" if group == "right" else "l"
    other = "l" if side == "r" else "r"
    out = [F.col(f"{other}.{x}" if x in include else f"{side}.{x}").alias(x) for x in labels]
    x, y = F.col("l.value"), F.col("r.value")
    if op in ARITHMETIC:
        value, hit = ARITHMETIC[op](x, y), F.lit(True)
    else:
        test = COMPARE[op](x, y)
        value, hit = (test.cast("double"), F.lit(True)) if as_bool else (x, test)
    found = joined.where(hit).select(*out, F.col("l.t").alias("t"), value.alias("value"))
    if group:  # labels that are taken from the one side may make two series one
        found = _unique(found, labels, "result")
    return Vector(found, labels)


def set_op(a: Vector, op: str, b: Vector, on: Sequence[str] | None = None, ignoring: Sequence[str] | None = None) -> Vector:
    """and, or, unless by signature, many to many."""
    keys = _signature(a, b, on, ignoring)
    left, right = _with_labels(a, keys), _with_labels(b, keys)
    same = [*keys, "t"]
    if op == "and":
        return Vector(left.join(right.select(*same), same, "left_semi").select(*a.labels, "t", "value"), a.labels)
    if op == "unless":
        return Vector(left.join(right.select(*same), same, "left_anti").select(*a.labels, "t", "value"), a.labels)
    labels = tuple(dict.fromkeys((*a.labels, *b.labels)))
    more = right.join(left.select(*same), same, "left_anti")
    return Vector(_with_labels(a, labels).select(*labels, "t", "value").unionByName(_with_labels(Vector(more, b.labels), labels).select(*labels, "t", "value")), labels)


def label_replace(v: Vector, dst: str, replacement: str, src: str, pattern: str) -> Vector:
    """dst from src by an anchored pattern with $1 or ${name}; series that don't match stay as they are."""
    have = F.coalesce(F.col(src).cast("string"), F.lit("")) if src in v.labels else F.lit("")
    new = F.regexp_replace(have, f"^(?s:{pattern})$", replacement)
    old = F.col(dst) if dst in v.labels else F.lit("")
    return Vector(v.df.withColumn(dst, F.when(have.rlike(f"^(?s:{pattern})$"), new).otherwise(old)), tuple(dict.fromkeys((*v.labels, dst))))


def label_join(v: Vector, dst: str, separator: str, *src: str) -> Vector:
    parts = [F.coalesce(F.col(x).cast("string"), F.lit("")) if x in v.labels else F.lit("") for x in src]
    return Vector(v.df.withColumn(dst, F.concat_ws(separator, *parts)), tuple(dict.fromkeys((*v.labels, dst))))


def ordered(v: Vector, descending: bool = False, labels: Sequence[str] = ()) -> DataFrame:
    """Rows by value, NaN last, or by the given labels."""
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    return v.df.orderBy(*[turn(x) for x in labels]) if labels else v.df.orderBy(F.isnan("value"), turn("value"))


def scalar(v: Vector, times: Times) -> Vector:
    """The one sample of each time, NaN unless there is exactly one."""
    one = v.df.groupBy("t").agg(F.when(F.count("*") == 1, F.first("value")).otherwise(F.lit(NAN)).alias("x"))
    return Vector(times.frame(v.df).join(one, "t", "left").select("t", F.coalesce("x", F.lit(NAN)).alias("value")), ())


def absent(v: Vector, times: Times, labels: dict[str, str] | None = None) -> Vector:
    """1 at each time without any sample, with the labels that the selector fixes."""
    labels = labels or {}
    gone = times.frame(v.df).join(v.df.select("t").distinct(), "t", "left_anti")
    return Vector(gone.select(*[F.lit(x).alias(k) for k, x in labels.items()], "t", F.lit(1.0).alias("value")), tuple(labels))


def absent_over_time(s: Series, times: Times, window: int, labels: dict[str, str] | None = None, offset: int = 0) -> Vector:
    """1 at each time whose window holds no sample of any series."""
    return absent(over(s, "present", times, window, offset), times, labels)


def time_of(like: DataFrame, times: Times) -> Vector:
    """Each evaluation time, in seconds."""
    return Vector(times.frame(like).select("t", (F.col("t") / 1000).alias("value")), ())


def constant(like: DataFrame, x: float, times: Times) -> Vector:
    """One number at all times, without labels; pi() is constant(df, math.pi, times)."""
    return Vector(times.frame(like).select("t", F.lit(float(x)).alias("value")), ())


def timestamps(s: Series, times: Times, lookback: int, offset: int = 0) -> Vector:
    """The time, in seconds, of the sample that instant() takes."""
    return instant(Series(s.df.withColumn("value", F.col("ts") / 1000), s.labels), times, lookback, offset)


def pairwise(v: Vector, op: str, x: float) -> Vector:
    """clamp_min (the larger of value and x) or clamp_max (the smaller); NaN stays."""
    return mapped(v, _clamp(x, INF) if op == "clamp_min" else _clamp(-INF, x))


def histogram_quantiles(v: Vector, label: str, qs: Sequence[float], le: str = "le") -> Vector:
    """histogram_quantile for several q, which become a label."""
    each = [histogram_quantile(v, q, le) for q in qs]
    frames = [r.df.withColumn(label, F.lit(f"{q:g}")) for q, r in zip(qs, each, strict=True)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return Vector(out, (*each[0].labels, label))


def histogram_quantile(v: Vector, q: float, le: str = "le") -> Vector:
    """Quantile of classic buckets; they must end in +Inf and are made to ascend."""
    keys = tuple(x for x in v.labels if x != le)
    bound = F.when(F.col(le) == "+Inf", F.lit(INF)).otherwise(F.expr(f"try_cast(`{le}` AS double)"))
    df = v.df.withColumn("_le", bound).where(F.col("_le").isNotNull()).groupBy(*keys, "t", "_le").agg(F.sum("value").alias("c"))
    w = Window.partitionBy(*keys, "t").orderBy("_le").rowsBetween(Window.unboundedPreceding, 0)
    up = df.withColumn("c", F.max("c").over(w))
    whole = Window.partitionBy(*keys, "t")
    by_le = whole.orderBy("_le")
    steps = up.select(*keys, "t", "_le", "c", F.lag("_le").over(by_le).alias("low"), F.lag("c", 1, 0.0).over(by_le).alias("before"), F.max("c").over(whole).alias("total"), F.max("_le").over(whole).alias("top"), F.count("*").over(whole).alias("n"))
    rank = F.lit(q) * F.col("total")
    hit = steps.where(F.col("c") >= rank).groupBy(*keys, "t").agg(F.min_by(F.struct("_le", "c", "low", "before", "total", "top", "n"), "_le").alias("_b"))
    b = F.col("_b")
    start = F.coalesce(b["low"], F.when(b["_le"] > 0, F.lit(0.0)).otherwise(b["_le"]))
    inside = start + (b["_le"] - start) * F.try_divide(F.lit(q) * b["total"] - b["before"], b["c"] - b["before"])
    value = F.when((b["top"] != INF) | (b["n"] < 2) | (b["total"] == 0), F.lit(NAN)).when(b["_le"] == INF, b["low"]).when(b["low"].isNull() & (b["_le"] <= 0), b["_le"]).otherwise(inside)
    if q < 0 or q > 1:
        value = F.lit(-INF if q < 0 else INF)
    return Vector(hit.select(*keys, "t", value.alias("value")), keys)


def info(v: Vector, facts: Vector, keys: Sequence[str] = ("instance", "job"), take: Sequence[str] | None = None) -> Vector:
    """Labels of an info metric for the series that share its identifying labels; others stay."""
    more = [x for x in facts.labels if x not in keys and x not in v.labels and (take is None or x in take)]
    # one info series per identity, or the join would repeat series: of several the first by its labels
    one = facts.df.groupBy(*keys, "t").agg(F.min(F.struct(*more)).alias("_facts")).select(*keys, "t", "_facts.*") if more else facts.df.select(*keys, "t").distinct()
    return Vector(v.df.join(one, [*keys, "t"], "left"), (*v.labels, *more))


def over_groups(df: DataFrame, keys: Sequence[str], identity: Sequence[str], ts: str, value: str, kind: str, window: int, at: int) -> DataFrame:
    """rate or increase of a table's samples per group, in the window (at - window, at] of milliseconds that ends at the bound evaluation time.

    identity: the table's unique key. The groups must be its series, that is the key without the time: a rate over
    samples of mixed series would take the change from one series to another for a rise."""
    if kind not in ("rate", "increase"):
        raise ValueError("rate or increase")
    if set(keys) != set(identity) - {ts}:
        raise ValueError(f"groups {sorted(keys)} aren't the series {sorted(set(identity) - {ts})}")
    return over(series(df, ts, value, keys), kind, Times(at, at), window).df.drop("t")


def trailing(df: DataFrame, ts: str, window: int, at: int) -> DataFrame:
    """Rows with a time in (at - window, at] in milliseconds, at the bound evaluation time; the scan is pruned by literals."""
    kind = df.schema[ts].dataType.simpleString()
    bound = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
    return df.where((F.col(ts) > bound(at - window)) & (F.col(ts) <= bound(at)))
