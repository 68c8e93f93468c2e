"""Time-series queries over `events`: series by event_type and user_id, evaluated at fixed times."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.operators import timeseries as ts
from cairnflow.sources.tables import table

HOUR = 3_600_000
START = 1_704_844_800_000  # 2024-01-10T00:00:00Z
#: All of the events, 2024-01-01 to 2024-01-30, and the empty windows at both ends.
GRID = ts.Times(1_704_067_200_000, 1_704_067_200_000 + 30 * 24 * HOUR, 6 * HOUR)
ONE = ts.Times(START, START)
#: Two days without an empty window: scalar() is NaN at a time without samples, where the SQL of ts_scalar has no row.
SOME = ts.Times(START, START + 48 * HOUR, 6 * HOUR)
WINDOW = 12 * HOUR

Query = Callable[[SparkSession, str], DataFrame]


def gauge(spark: SparkSession, sf_dir: str, *labels: str) -> ts.Series:
    return ts.series(table(spark, sf_dir, "events"), "ts", "value", labels or ("event_type",))


def counter(spark: SparkSession, sf_dir: str) -> ts.Series:
    """A running sum per event type that falls back every hundredth event."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.floor(F.col("event_id") / 100)).orderBy("ts")
    return ts.series(e.withColumn("total", F.sum(F.floor("value")).over(w)), "ts", "total", ("event_type",))


_S = "s AS (SELECT event_type, user_id, event_id, epoch_us(ts) // 1000 AS ts, ts AS tt, value FROM events)"
_C = "s AS (SELECT event_type, epoch_us(ts) // 1000 AS ts, CAST(sum(floor(value)) OVER (PARTITION BY event_type, event_id // 100 ORDER BY ts) AS DOUBLE) AS value FROM events)"
_G = f"g AS (SELECT unnest(generate_series({GRID.start}, {GRID.end}, {GRID.step})) AS t)"


def _w(labels: str = "event_type", samples: str = _S, window: int = WINDOW, offset: int = 0, grid: str = _G) -> str:
    """Samples paired with evaluation times, and the sample before in the window."""
    return f"""WITH {samples}, {grid},
w AS (SELECT *, t - {offset} - {window} AS open, lag(value) OVER (PARTITION BY {labels}, t ORDER BY ts) AS p, lag(ts) OVER (PARTITION BY {labels}, t ORDER BY ts) AS pt
      FROM s JOIN g ON s.ts > g.t - {offset} - {window} AND s.ts <= g.t - {offset})
"""


def _agg(expression: str, labels: str = "event_type", having: str = "", **more) -> str:
    return _w(labels, **more) + f"SELECT {labels}, t, {expression} AS value FROM w GROUP BY {labels}, t {having}"


_RATE = """, a AS (SELECT event_type, t, open, count(*) AS n, min(ts) AS ft, max(ts) AS lt, arg_min(value, ts) AS fv, arg_max(value, ts) AS lv,
  sum(CASE WHEN value < p THEN p ELSE 0 END) AS r FROM w GROUP BY event_type, t, open),
b AS (SELECT *, (lt - ft) / 1000.0 AS si, (lt - ft) / 1000.0 / (n - 1) AS ai, lv - fv + {resets} AS d, (ft - open) / 1000.0 AS a0, (open + {window} - lt) / 1000.0 AS b0 FROM a WHERE n >= 2 AND lt > ft),
c AS (SELECT *, CASE WHEN a0 >= 1.1 * ai THEN ai / 2 ELSE a0 END AS a1, CASE WHEN b0 >= 1.1 * ai THEN ai / 2 ELSE b0 END AS b1 FROM b),
e AS (SELECT *, CASE WHEN {counter} AND d > 0 AND fv >= 0 THEN least(a1, si * fv / d) ELSE a1 END AS a2 FROM c)
SELECT event_type, t, round(d * (si + a2 + b1) / si / {per}, 9) AS value FROM e"""


def _rated(fn: str) -> str:
    counter_ = fn != "delta"
    return _w(samples=_C) + _RATE.format(resets="r" if counter_ else "0", window=WINDOW, counter="TRUE" if counter_ else "FALSE", per=WINDOW / 1000 if fn == "rate" else 1)


def _r(v: ts.Vector, digits: int = 9) -> DataFrame:
    return v.df.withColumn("value", F.round("value", digits))


def _over(fn: str, digits: int = 9, of=gauge, **args) -> Query:
    return lambda spark, d: _r(ts.over(of(spark, d), fn, GRID, WINDOW, **args), digits)


def _sums(spark: SparkSession, d: str, *labels: str) -> ts.Vector:
    return ts.over(gauge(spark, d, *labels), "sum", GRID, WINDOW)


def _counts(spark: SparkSession, d: str, *labels: str) -> ts.Vector:
    return ts.over(gauge(spark, d, *labels), "count", GRID, WINDOW)


_SUM = "SELECT event_type, t, sum(value) AS value, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY event_type, t"
_BUCKETS = (10, 50, 100, 250)


def _histogram(spark: SparkSession, d: str) -> ts.Vector:
    e = table(spark, d, "events")
    rows = e.select("event_type", "ts", "value", F.explode(F.array(*[F.lit(float(b)) for b in _BUCKETS], F.lit(float("inf")))).alias("b")).where("value <= b")
    le = F.when(F.col("b") == float("inf"), F.lit("+Inf")).otherwise(F.col("b").cast("int").cast("string"))
    return ts.over(ts.series(rows.withColumn("le", le), "ts", F.lit(1.0), ("event_type", "le")), "sum", GRID, WINDOW)


_HIST_SQL = _w() + f""", h AS (SELECT event_type, t, b, count(*) FILTER (value <= b) AS c FROM w CROSS JOIN (SELECT unnest([{", ".join(f"{b}.0" for b in _BUCKETS)}, 'inf'::DOUBLE]) AS b) GROUP BY event_type, t, b HAVING c > 0),
k AS (SELECT *, lag(b) OVER z AS low, coalesce(lag(c) OVER z, 0) AS before, max(c) OVER (PARTITION BY event_type, t) AS total FROM h WINDOW z AS (PARTITION BY event_type, t ORDER BY b)),
m AS (SELECT event_type, t, arg_min(struct_pack(b := b, c := c, low := low, before := before, total := total), b) AS x FROM k WHERE c >= 0.9 * total GROUP BY event_type, t)
SELECT event_type, t, round(CASE WHEN isinf(x.b) THEN x.low ELSE coalesce(x.low, 0) + (x.b - coalesce(x.low, 0)) * (0.9 * x.total - x.before) / (x.c - x.before) END, 9) AS value FROM m"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    per_user = _sums(spark, d, "event_type", "user_id")
    return _r(ts.binary(per_user, "/", _sums(spark, d), on=["event_type"], group="left"))


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    v = ts.label_replace(_counts(spark, d), "kind", "$1-$2", "event_type", "(p|v)(.*)")
    return ts.label_join(v, "both", "/", "event_type", "kind").df


def _subquery(spark: SparkSession, d: str) -> DataFrame:
    inner = ts.over(gauge(spark, d), "avg", ts.Times(GRID.start - 24 * HOUR, GRID.end, HOUR), 3 * HOUR)
    return _r(ts.over(ts.subquery(inner), "max", GRID, 24 * HOUR))


def _regressed(fn: str) -> str:
    x = "(ts - t) / 1000.0"
    value = f"regr_slope(value, {x})" if fn == "deriv" else f"regr_intercept(value, {x}) + 3600 * regr_slope(value, {x})"
    return _agg(f"round({value}, 6)", having="HAVING count(*) >= 2")


#: Numbers at the edges of arithmetic, as one series each, and times of the calendar.
_ODD = ("nan", "inf", "-inf", "1e300", "-1e300", "1e-13", "2e-13", "-0.5", "0.5", "1.5", "2.5", "0", "-7.25", "9007199254740993")
_TIMES = ("nan", "0", "951782400", "1709164800.5", "1735689599", "-1")


def _numbers(spark: SparkSession, texts: tuple[str, ...]) -> ts.Vector:
    rows = [(t, 0, float(t)) for t in texts]
    return ts.Vector(spark.createDataFrame(rows, "x string, t long, value double"), ("x",))


def _pointwise(fns: tuple[str, ...], texts: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _numbers(spark, texts).df
        shown = lambda c: F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) == F.lit(float("inf")), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(F.format_string("%.6e", c))
        return df.select("x", *[shown(ts.POINTWISE[f](F.col("value")).cast("double")).alias(f) for f in fns])

    return run


def _pointwise_sql(columns: dict[str, str], texts: tuple[str, ...]) -> str:
    values = ", ".join(f"('{t}', CAST('{t}' AS DOUBLE))" for t in texts)
    shown = ", ".join(f"CASE WHEN isnan({c}) THEN 'nan' WHEN isinf({c}) THEN CASE WHEN {c} > 0 THEN 'inf' ELSE '-inf' END ELSE format('{{:.6e}}', CAST({c} AS DOUBLE)) END AS {n}" for n, c in columns.items())
    return f"SELECT x, {shown} FROM (VALUES {values}) AS v(x, value)"


_LN = "CASE WHEN isnan(value) OR value < 0 THEN 'nan'::DOUBLE WHEN value = 0 THEN '-inf'::DOUBLE ELSE {}(CASE WHEN value > 0 THEN value ELSE 1 END) END"
_SAFE = "CASE WHEN isnan(value) OR isinf(value) THEN 'nan'::DOUBLE ELSE {}(CASE WHEN isinf(value) THEN 0 ELSE value END) END"
_UNIT = "CASE WHEN abs(value) <= 1 THEN {}(CASE WHEN abs(value) <= 1 THEN value ELSE 0 END) ELSE 'nan'::DOUBLE END"
_POINTWISE_SQL = {
    "abs": "abs(value)", "ceil": "ceil(value)", "floor": "floor(value)", "round": "CASE WHEN abs(value) < 9e15 THEN floor(value + 0.5) ELSE value END", "exp": "exp(value)",
    "ln": _LN.format("ln"), "log2": _LN.format("log2"), "log10": _LN.format("log10"), "sqrt": "CASE WHEN value < 0 THEN 'nan'::DOUBLE ELSE sqrt(abs(value)) END", "sgn": "CASE WHEN isnan(value) THEN value ELSE CAST(sign(value) AS DOUBLE) END",
    "atan": "atan(value)", "sinh": "CASE WHEN isnan(value) OR isinf(value) THEN value ELSE sinh(value) END", "cosh": "CASE WHEN isnan(value) THEN value WHEN isinf(value) THEN abs(value) ELSE cosh(value) END", "tanh": "tanh(value)",
    "deg": "degrees(value)", "rad": "radians(value)", "asin": _UNIT.format("asin"), "acos": _UNIT.format("acos"),
}
_TRIG = ("-0.5", "0.5", "1.5", "0", "-7.25", "nan")
_TRIG_SQL = {f: _SAFE.format(f) for f in ("sin", "cos", "tan", "asinh")} | {"acosh": "CASE WHEN value >= 1 THEN acosh(CASE WHEN value >= 1 THEN value ELSE 1 END) ELSE 'nan'::DOUBLE END", "atanh": "CASE WHEN abs(value) < 1 THEN atanh(CASE WHEN abs(value) < 1 THEN value ELSE 0 END) ELSE 'nan'::DOUBLE END"}
_AT = "(to_timestamp(CASE WHEN isnan(value) THEN 0 ELSE floor(value) END) AT TIME ZONE 'UTC')"
_CALENDAR_SQL = {n: f"CASE WHEN isnan(value) THEN value ELSE CAST({e} AS DOUBLE) END" for n, e in {
    "minute": f"minute({_AT})", "hour": f"hour({_AT})", "day_of_week": f"dayofweek({_AT})", "day_of_month": f"day({_AT})", "day_of_year": f"dayofyear({_AT})", "month": f"month({_AT})", "year": f"year({_AT})", "days_in_month": f"day(last_day({_AT}))",
}.items()}


def _counted(spark: SparkSession, d: str) -> DataFrame:
    v = _numbers(spark, ("0", "1e-13", "2e-13", "1e-13", "0.1", "12.5", "1e7", "nan"))
    return ts.count_values(v, "n").df


QUERIES: dict[str, tuple[Query, str | None]] = {
    "ts_instant": (lambda s, d: ts.instant(gauge(s, d, "event_type", "user_id"), GRID, WINDOW).df, _agg("arg_max(value, tt)", "event_type, user_id")),
    "ts_matchers": (lambda s, d: ts.instant(ts.matching(gauge(s, d), ("event_type", "=~", "p.*|view"), ("event_type", "!=", "view")), GRID, WINDOW).df, _w() + "SELECT event_type, t, arg_max(value, tt) AS value FROM w WHERE event_type LIKE 'p%' GROUP BY event_type, t"),
    "ts_offset": (lambda s, d: _r(ts.over(gauge(s, d), "sum", GRID, WINDOW, offset=24 * HOUR), 6), _agg("round(sum(value), 6)", offset=24 * HOUR)),
    "ts_at": (lambda s, d: _r(ts.over(gauge(s, d), "sum", GRID, WINDOW, at=START), 6), f"WITH {_S}, {_G} SELECT event_type, t, round(sum(value), 6) AS value FROM s CROSS JOIN g WHERE ts > {START - WINDOW} AND ts <= {START} GROUP BY event_type, t"),
    "ts_rate": (lambda s, d: _r(ts.over(counter(s, d), "rate", GRID, WINDOW)), _rated("rate")),
    "ts_increase": (lambda s, d: _r(ts.over(counter(s, d), "increase", GRID, WINDOW)), _rated("increase")),
    "ts_delta": (lambda s, d: _r(ts.over(counter(s, d), "delta", GRID, WINDOW)), _rated("delta")),
    "ts_irate": (_over("irate", of=counter), _w(samples=_C) + "SELECT event_type, t, round(CASE WHEN value < p THEN value ELSE value - p END / ((ts - pt) / 1000.0), 9) AS value FROM w WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY ts DESC) = 1"),
    "ts_idelta": (_over("idelta", of=counter), _w(samples=_C) + "SELECT event_type, t, value - p AS value FROM w WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY ts DESC) = 1"),
    "ts_changes": (_over("changes", of=counter), _agg("CAST(count(*) FILTER (value <> p) AS DOUBLE)", samples=_C)),
    "ts_resets": (_over("resets", of=counter), _agg("CAST(count(*) FILTER (value < p) AS DOUBLE)", samples=_C)),
    "ts_deriv": (_over("deriv", 6), _regressed("deriv")),
    "ts_predict_linear": (_over("predict_linear", 6, ahead=3600.0), _regressed("predict")),
    "ts_smoothing": (_over("double_exponential_smoothing", sf=0.5, tf=0.3), None),
    "ts_mad": (_over("mad", 6), _agg("round(mad(value), 6)")),
    "ts_distinct": (_over("distinct"), _agg("CAST(count(DISTINCT value) AS DOUBLE)")),
    "ts_entropy": (_over("entropy", 6), _agg("round(entropy(value), 6)")),
    "ts_l2": (_over("l2"), _w() + "SELECT event_type, t, round(sqrt(sum(c * c)), 9) AS value FROM (SELECT event_type, t, value AS v, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL) GROUP BY event_type, t"),
    **{f"ts_{fn}_over_time": (_over(fn, 6, **args), _agg(f"round({sql}, 6)")) for fn, sql, args in (
        ("sum", "sum(value)", {}), ("avg", "avg(value)", {}), ("min", "min(value)", {}), ("max", "max(value)", {}), ("count", "CAST(count(*) AS DOUBLE)", {}), ("stddev", "stddev_pop(value)", {}), ("stdvar", "var_pop(value)", {}),
        ("quantile", "quantile_cont(value, 0.9)", {"q": 0.9}), ("last", "arg_max(value, tt)", {}), ("first", "arg_min(value, tt)", {}), ("present", "CAST(1 AS DOUBLE)", {}), ("ts_of_min", "arg_min(ts, {'a': value, 'b': -ts}) / 1000.0", {}),
        ("ts_of_max", "arg_max(ts, {'a': value, 'b': ts}) / 1000.0", {}), ("ts_of_first", "min(ts) / 1000.0", {}), ("ts_of_last", "max(ts) / 1000.0", {}),
    )},
    **{f"ts_agg_{op}": (lambda s, d, op=op: _r(ts.aggregate(_counts(s, d, "event_type", "user_id"), op, by=["event_type"], q=0.75), 6),
                        _w("event_type, user_id") + f"SELECT event_type, t, round({sql}, 6) AS value FROM (SELECT event_type, user_id, t, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL) GROUP BY event_type, t") for op, sql in (
        ("sum", "sum(c)"), ("avg", "avg(c)"), ("min", "min(c)"), ("max", "max(c)"), ("count", "CAST(count(*) AS DOUBLE)"), ("group", "CAST(1 AS DOUBLE)"), ("stddev", "stddev_pop(c)"), ("stdvar", "var_pop(c)"), ("quantile", "quantile_cont(c, 0.75)"),
    )},
    "ts_agg_without": (lambda s, d: _r(ts.aggregate(_counts(s, d, "event_type", "user_id"), "sum", without=["event_type"])), _agg("CAST(count(*) AS DOUBLE)", "user_id")),
    "ts_count_values": (lambda s, d: ts.count_values(_counts(s, d, "event_type", "user_id"), "n", by=["event_type"]).df, _w("event_type, user_id") + "SELECT event_type, t, CAST(c AS VARCHAR) AS n, CAST(count(*) AS DOUBLE) AS value FROM (SELECT event_type, user_id, t, count(*) AS c FROM w GROUP BY ALL) GROUP BY event_type, t, c"),
    "ts_topk": (lambda s, d: ts.ranked(_counts(s, d, "event_type", "user_id"), "topk", 3, by=["event_type"]).df, _w("event_type, user_id") + "SELECT * FROM (SELECT event_type, user_id, t, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY value DESC, user_id) <= 3"),
    "ts_bottomk": (lambda s, d: ts.ranked(_counts(s, d, "event_type", "user_id"), "bottomk", 2).df, _w("event_type, user_id") + "SELECT * FROM (SELECT event_type, user_id, t, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t ORDER BY value, event_type, user_id) <= 2"),
    "ts_limitk": (lambda s, d: ts.ranked(_counts(s, d), "limitk", 2).df, _w() + "SELECT * FROM (SELECT event_type, t, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t ORDER BY event_type) <= 2"),
    "ts_limit_ratio": (lambda s, d: ts.limit_ratio(_counts(s, d, "event_type", "user_id"), 0.3).df, None),
    "ts_scalar_arithmetic": (lambda s, d: _r(ts.with_scalar(ts.with_scalar(_counts(s, d), "*", 3), "/", 7, flipped=True)), _agg("round(7 / (3.0 * count(*)), 9)")),
    "ts_scalar_compare": (lambda s, d: ts.with_scalar(_counts(s, d), ">", 5).df, _agg("CAST(count(*) AS DOUBLE)", having="HAVING count(*) > 5")),
    "ts_compare_bool": (lambda s, d: ts.with_scalar(_counts(s, d), ">", 5, as_bool=True).df, _agg("CAST(CAST(count(*) > 5 AS INTEGER) AS DOUBLE)")),
    "ts_vector_match": (lambda s, d: _r(ts.binary(_sums(s, d), "/", _counts(s, d))), _w() + f"SELECT event_type, t, round(value / n, 9) AS value FROM ({_SUM})"),
    "ts_group_left": (_matched, _w("event_type, user_id") + ", u AS (SELECT event_type, user_id, t, sum(value) AS v FROM w GROUP BY ALL) SELECT event_type, user_id, t, round(v / sum(v) OVER (PARTITION BY event_type, t), 9) AS value FROM u"),
    "ts_set_and": (lambda s, d: _r(ts.set_op(_sums(s, d), "and", ts.with_scalar(_counts(s, d), ">", 5)), 6), _agg("round(sum(value), 6)", having="HAVING count(*) > 5")),
    "ts_set_or": (lambda s, d: _r(ts.set_op(ts.with_scalar(_counts(s, d), ">", 5), "or", ts.with_scalar(_counts(s, d), "*", -1)), 6), _agg("CAST(CASE WHEN count(*) > 5 THEN count(*) ELSE -count(*) END AS DOUBLE)")),
    "ts_set_unless": (lambda s, d: _r(ts.set_op(_sums(s, d), "unless", ts.with_scalar(_counts(s, d), ">", 5)), 6), _agg("round(sum(value), 6)", having="HAVING count(*) <= 5")),
    "ts_label_functions": (_replaced, _w() + "SELECT event_type, t, CAST(count(*) AS DOUBLE) AS value, k AS kind, event_type || '/' || k AS both FROM (SELECT *, CASE WHEN event_type[1] IN ('p', 'v') THEN event_type[1] || '-' || event_type[2:] ELSE '' END AS k FROM w) GROUP BY event_type, t, k"),
    "ts_subquery": (_subquery, f"""WITH {_S}, i AS (SELECT unnest(generate_series({GRID.start - 24 * HOUR}, {GRID.end}, {HOUR})) AS i), v AS (SELECT event_type, i AS ts, avg(value) AS value FROM s JOIN i ON s.ts > i.i - {3 * HOUR} AND s.ts <= i.i GROUP BY event_type, i), {_G}
        SELECT event_type, t, round(max(value), 9) AS value FROM v JOIN g ON v.ts > g.t - {24 * HOUR} AND v.ts <= g.t GROUP BY event_type, t"""),
    "ts_histogram_quantile": (lambda s, d: _r(ts.histogram_quantile(_histogram(s, d), 0.9)), _HIST_SQL),
    "ts_absent": (lambda s, d: ts.absent(ts.instant(ts.matching(gauge(s, d), ("event_type", "=", "nothing")), GRID, WINDOW), GRID, {"event_type": "nothing"}).df, f"WITH {_G} SELECT 'nothing' AS event_type, t, CAST(1 AS DOUBLE) AS value FROM g"),
    "ts_scalar": (lambda s, d: _r(ts.scalar(ts.aggregate(ts.over(gauge(s, d), "sum", SOME, WINDOW), "sum"), SOME), 6), f"WITH {_S}, g AS (SELECT unnest(generate_series({SOME.start}, {SOME.end}, {SOME.step})) AS t) SELECT t, round(sum(value), 6) AS value FROM s JOIN g ON s.ts > g.t - {WINDOW} AND s.ts <= g.t GROUP BY t"),
    "ts_clamp_round": (lambda s, d: ts.rounded(ts.clamp(_counts(s, d), 2, 9), 5).df, _agg("floor(greatest(2, least(9, count(*))) / 5.0 + 0.5) * 5")),
    "ts_math": (lambda s, d: _r(ts.mapped(ts.mapped(_counts(s, d), ts.POINTWISE["ln"]), ts.POINTWISE["sqrt"])), _agg("round(sqrt(ln(count(*))), 9)")),
    "ts_pointwise": (_pointwise(tuple(_POINTWISE_SQL), _ODD), _pointwise_sql(_POINTWISE_SQL, _ODD)),
    "ts_trigonometry": (_pointwise(tuple(_TRIG_SQL), _TRIG), _pointwise_sql(_TRIG_SQL, _TRIG)),
    "ts_calendar": (_pointwise(tuple(_CALENDAR_SQL), _TIMES), _pointwise_sql(_CALENDAR_SQL, _TIMES)),
    "ts_count_values_text": (_counted, "SELECT * FROM (VALUES ('0', 0, 1.0::DOUBLE), ('0.0000000000001', 0, 2), ('0.0000000000002', 0, 1), ('0.1', 0, 1), ('12.5', 0, 1), ('10000000', 0, 1), ('NaN', 0, 1)) AS v(n, t, value)"),
    "ts_time": (lambda s, d: ts.time_of(gauge(s, d).df, GRID).df, f"WITH {_G} SELECT t, t / 1000.0::DOUBLE AS value FROM g"),
    "ts_vector_pi": (lambda s, d: _r(ts.constant(gauge(s, d).df, math.pi, GRID)), f"WITH {_G} SELECT t, round(pi(), 9) AS value FROM g"),
    "ts_timestamp": (lambda s, d: ts.timestamps(gauge(s, d), GRID, WINDOW).df, _agg("max(ts) / 1000.0")),
    "ts_absent_over_time": (lambda s, d: ts.absent_over_time(ts.matching(gauge(s, d), ("event_type", "=", "error")), GRID, HOUR, {"event_type": "error"}).df,
                            f"WITH {_S}, {_G} SELECT 'error' AS event_type, t, CAST(1 AS DOUBLE) AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'error' AND ts > t - {HOUR} AND ts <= t)"),
    "ts_clamp_min_max": (lambda s, d: ts.pairwise(ts.pairwise(_counts(s, d), "clamp_min", 3), "clamp_max", 8).df, _agg("CAST(least(8, greatest(3, count(*))) AS DOUBLE)")),
    "ts_histogram_quantiles": (lambda s, d: _r(ts.histogram_quantiles(_histogram(s, d), "q", (0.5, 0.9))),
                               f"SELECT event_type, '0.9' AS q, t, value FROM ({_HIST_SQL}) UNION ALL SELECT event_type, '0.5' AS q, t, value FROM ({_HIST_SQL.replace('0.9', '0.5')})"),
    "ts_sort": (lambda s, d: ts.ordered(_counts(s, d), descending=True), _agg("CAST(count(*) AS DOUBLE)")),
    "ts_info": (lambda s, d: ts.info(_counts(s, d), ts.Vector(_counts(s, d).df.select("event_type", F.upper("event_type").alias("kind"), "t", "value"), ("event_type", "kind")), keys=("event_type",)).df, _agg("CAST(count(*) AS DOUBLE)").replace("SELECT event_type, t,", "SELECT event_type, upper(event_type) AS kind, t,")),
    "ts_time_functions": (lambda s, d: ts.mapped(ts.over(gauge(s, d), "ts_of_last", GRID, WINDOW), ts.POINTWISE["hour"]).df, _agg("CAST(hour(to_timestamp(max(ts) // 1000) AT TIME ZONE 'UTC') AS DOUBLE)")),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
