"""Summaries and window states over the driver's tables. A sketch is held against the exact result and reports whether
it is within its error, so that the outcome is the same on any engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.functions import accuracy, shims
from cairnflow.operators import summaries as sk
from cairnflow.operators import timeseries as ts
from cairnflow.operators import views
from cairnflow.plans.series_queries import GRID, HOUR, counter, gauge
from cairnflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
WIDTH, WINDOW = 2 * HOUR, 12 * HOUR
_OK = "SELECT event_type, TRUE AS ok FROM events GROUP BY event_type"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def ddsketch(spark: SparkSession, d: str) -> DataFrame:
    """p99 from states of single days, merged."""
    alpha = accuracy.ddsketch_alpha(accuracy.Target(0.01))
    days = sk.ddsketch(_events(spark, d).withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", alpha)
    got = sk.ddsketch_quantile(sk.merged(days, ["event_type"], ["sign", "bucket"]), ["event_type"], 0.99, alpha)
    w = Window.partitionBy("event_type")
    ranked = _events(spark, d).select("event_type", F.col("value").alias("x"), F.row_number().over(w.orderBy("value")).alias("r"), F.count("*").over(w).alias("n"))
    exact = ranked.where(F.col("r") == F.floor(F.lit(0.99) * (F.col("n") - 1)) + 1)
    return got.join(exact, "event_type").select("event_type", (F.abs(F.col("value") - F.col("x")) <= 2 * alpha * F.abs("x")).alias("ok"))


def count_min(spark: SparkSession, d: str, signed: bool = False) -> DataFrame:
    """Events per user from states of event types, rolled up."""
    target = accuracy.Target(0.01, 0.001)
    width, depth = accuracy.count_sketch_size(accuracy.Target(0.05, 0.001)) if signed else accuracy.count_min_size(target)
    e = _events(spark, d)
    states = sk.merged(sk.count_min(e, ["event_type"], ["user_id"], width, depth, signed=signed), [], ["row", "cell"])
    exact = e.groupBy("user_id").agg(F.count("*").alias("n"))
    got = sk.estimates(states, exact.select("user_id"), [], ["user_id"], width, depth, signed).join(exact, "user_id")
    n = F.lit(e.count())
    error = F.abs(F.col("estimate") - F.col("n")) <= 0.05 * n if signed else (F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + 0.01 * n)
    return got.select("user_id", error.alias("ok"))


def distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """HLL, theta and KMV of suppliers per flag, from states per line status."""
    li = table(spark, d, "lineitem")
    k = 4323
    parts = li.groupBy("l_returnflag", "l_linestatus").agg(sk.hll("l_partkey", 15).alias("h"), sk.theta("l_partkey").alias("t"))
    whole = parts.groupBy("l_returnflag").agg(sk.hll_estimate(sk.hll_merged("h")).alias("hll"), F.expr("theta_sketch_estimate(theta_union_agg(t))").alias("theta"))
    small = sk.kmv_estimate(sk.kmv_merged(sk.kmv(li, ["l_returnflag", "l_linestatus"], ["l_partkey"], k), ["l_returnflag"], k), ["l_returnflag"], k)
    exact = li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"))
    near = lambda c, e: F.abs(F.col(c) - F.col("n")) <= e * F.col("n")
    joined = whole.join(small, "l_returnflag").join(exact, "l_returnflag")
    return joined.select("l_returnflag", near("hll", 0.05).alias("hll_ok"), near("theta", 0.1).alias("theta_ok"), near("distinct", 0.1).alias("kmv_ok"))


def kll(spark: SparkSession, d: str) -> DataFrame:
    """Median price per flag within twice the rank error, from merged states. The median is a price of the table, so it lies between the exact
    percentiles if enough prices are up to it and few enough below: two counts, where percentiles would hold all prices in a task."""
    k = accuracy.kll_size(accuracy.Target(0.02))
    e = 2 * accuracy.kll_error(k)
    li = table(spark, d, "lineitem")
    got = li.groupBy("l_returnflag", "l_linestatus").agg(sk.kll("l_extendedprice", k).alias("s")).groupBy("l_returnflag").agg(sk.kll_merged("s").alias("s")).select("l_returnflag", sk.kll_quantile("s", 0.5).alias("x"))
    return sk.within_ranks(li, "l_returnflag", "l_extendedprice", got, "x", 0.5 - e, 0.5 + e).withColumnRenamed("within", "ok")


def universal(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parts, L2 norm and entropy per flag from one sketch of 256 items a level (thousands of parts per flag), merged
    from states per month."""
    li = table(spark, d, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    states = sk.universal(li, ["l_returnflag", "month"], "l_partkey")
    s = sk.universal_merged(states, ["l_returnflag"], "l_partkey")
    counts = li.groupBy("l_returnflag", "l_partkey").agg(F.count("*").cast("double").alias("c"))
    exact = counts.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("l2"), F.sum(F.col("c") * F.log2("c")).alias("h"))
    for name, g in (("a", lambda w: F.lit(1.0)), ("b", lambda w: w * w), ("c", lambda w: w * F.log2(w))):
        exact = exact.join(sk.universal_sum(s, ["l_returnflag"], "l_partkey", g).withColumnRenamed("value", name), "l_returnflag")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.35 * F.abs(y) + 1
    return exact.select("l_returnflag", (near("a", "n") & near("b", "l2") & near("c", "h")).alias("ok"))


def kmv(spark: SparkSession, d: str) -> DataFrame:
    """Distinct order lines per flag by the 256 smallest hashes of tens of thousands, from states per line status."""
    li = table(spark, d, "lineitem")
    items = ["l_orderkey", "l_linenumber"]
    states = sk.kmv(li, ["l_returnflag", "l_linestatus"], items, 256)
    got = sk.kmv_estimate(sk.kmv_merged(states, ["l_returnflag"], 256), ["l_returnflag"], 256)
    exact = li.groupBy("l_returnflag").agg(F.countDistinct(*items).alias("n"))
    return got.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("distinct") - F.col("n")) <= 0.25 * F.col("n")).alias("ok"))


def top_states(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest order priorities and statuses from bounded states per month, which are combined; counts are at most those lost off."""
    orders = table(spark, d, "orders").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("item"), F.date_trunc("month", "o_orderdate").alias("month"))
    states = orders.groupBy("month").agg(sk.top_state("item", 1000).alias("s"))
    got = states.agg(sk.top_merged("s", 1000).alias("s")).select(F.explode(sk.top_read("s", 5)).alias("x")).select("x.item", "x.count")
    exact = orders.groupBy("item").agg(F.count("*").alias("n"))
    least = exact.orderBy(F.desc("n")).limit(5).agg(F.min("n").alias("least"))
    return got.join(exact, "item").crossJoin(F.broadcast(least)).agg(F.count("*").alias("items"), F.bool_and((F.col("count") == F.col("n")) & (F.col("n") >= F.col("least"))).alias("ok"))


def _slid(fn: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        source = counter(spark, d) if fn in ("rise", "rate", "increase", "irate") else gauge(spark, d)
        v = views.sliding(views.tumbling(source, WIDTH), source.labels, WIDTH, GRID, WINDOW, fn)
        return v.df.withColumn("value", F.round("value", 6))

    return run


def _slid_sql(fn: str) -> str:
    from cairnflow.plans.series_queries import _C, QUERIES as SERIES, _rated, _w

    if fn in ("rate", "increase"):
        return _rated(fn).replace(", 9) AS value FROM e", ", 6) AS value FROM e")
    if fn == "irate":
        return SERIES["ts_irate"][1].replace("1000.0), 9)", "1000.0), 6)")
    if fn == "rise":
        return _w(samples=_C, window=WINDOW) + "SELECT event_type, t, round(sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END), 6) AS value FROM w GROUP BY event_type, t"
    sql = {"sum": "sum(value)", "count": "CAST(count(*) AS DOUBLE)", "min": "min(value)", "max": "max(value)", "avg": "avg(value)"}[fn]
    return _w(window=WINDOW) + f"SELECT event_type, t, round({sql}, 6) AS value FROM w GROUP BY event_type, t"


def rolled(spark: SparkSession, d: str) -> DataFrame:
    """States per event type from states per event type and user."""
    fine = views.tumbling(gauge(spark, d, "event_type", "user_id"), WIDTH)
    return views.rollup(fine, ["event_type"]).select("event_type", "end", "n", F.round("total", 6).alias("total"), "low", "high")


def population(spark: SparkSession, d: str) -> DataFrame:
    """The three largest current values per event type."""
    now = views.latest_per_series(gauge(spark, d, "event_type", "user_id"))
    return ts.ranked(ts.Vector(now.withColumnRenamed("ts", "t").withColumn("t", F.lit(0).cast("long")), ("event_type", "user_id")), "topk", 3, by=["event_type"]).df.select("event_type", "user_id", "value")


def certified(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return views.certified_semi_join(orders, table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey")


def shimmed(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    m = shims.map_concat_first(F.create_map(F.lit("k"), F.col("n_nationkey")), F.create_map(F.lit("k"), F.lit(99), F.lit("r"), F.col("n_regionkey")))
    return n.select("n_nationkey", shims.map_value(m, F.lit("k"), 0).alias("k"), shims.map_value(m, F.lit("r"), 0).alias("r"), shims.map_value(m, F.lit("z"), 0).alias("z"), shims.array_value(F.array("n_regionkey"), -1, 0).alias("a"), shims.replace_first(F.col("n_name"), "[A-M]", "#").alias("f"))


def spellings(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    at = lambda seconds: F.unix_seconds(shims.start_of_interval(F.col("ts"), seconds))
    return e.select(
        "event_id", at(3600).alias("hour"), at(300).alias("five"), at(1800).alias("half"), shims.start_of_week(F.col("ts")).alias("sunday"), shims.start_of_week(F.col("ts"), 1).alias("monday"),
        F.try_element_at(shims.split_by_char("i", F.col("event_type")), F.lit(2)).alias("part"), F.size(shims.split_by_char("|", F.lit("a|b||"))).alias("parts"),
        shims.position_ci(F.upper("event_type"), "I").alias("at"), shims.position_ci(F.col("event_type"), "E", 3).alias("later"), F.floor(shims.epoch(F.col("ts").cast("timestamp"))).alias("epoch"),
    )


_SPELLINGS = """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS hour, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 AS five, CAST(floor(epoch(ts)) AS BIGINT) // 1800 * 1800 AS half,
  CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS sunday, CAST(date_trunc('week', ts) AS DATE) AS monday, string_split(event_type, 'i')[2] AS part, 4 AS parts, CAST(instr(event_type, 'i') AS BIGINT) AS at,
  CAST(CASE WHEN instr(event_type[3:], 'e') = 0 THEN 0 ELSE instr(event_type[3:], 'e') + 2 END AS BIGINT) AS later, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events"""


def framed(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts")
    e = _events(spark, d)
    return e.select("event_id", shims.in_frame(F.col("value"), order, -2, 0, -1, 0.0).alias("a"), shims.in_frame(F.col("value"), order, -2, 0, 1, 0.0).alias("b"), shims.in_frame(F.col("value"), order, -1, 2, 2, -1.0).alias("c"))


def correlated(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(shims.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"), shims.correlation(F.col("l_quantity"), F.lit(1.0)).alias("none"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "sk_ddsketch_p99": (ddsketch, _OK),
    "sk_count_min_point": (count_min, "SELECT user_id, TRUE AS ok FROM events GROUP BY user_id"),
    "sk_count_sketch_point": (lambda s, d: count_min(s, d, True), "SELECT user_id, TRUE AS ok FROM events GROUP BY user_id"),
    "sk_count_min_total": (lambda s, d: sk.total(sk.count_min(_events(s, d), ["event_type"], ["user_id"], 272, 5), ["event_type"]), "SELECT event_type, count(*) AS total FROM events GROUP BY event_type"),
    "sk_heavy_hitters": (lambda s, d: sk.heavy_hitters(_events(s, d), ["event_type"], "user_id", 5), "SELECT * FROM (SELECT event_type, user_id, count(*) AS w FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY w DESC, user_id) <= 5"),
    "sk_distinct": (distinct_sketches, "SELECT l_returnflag, TRUE AS hll_ok, TRUE AS theta_ok, TRUE AS kmv_ok FROM lineitem GROUP BY l_returnflag"),
    "sk_kll_median": (kll, "SELECT l_returnflag, TRUE AS ok FROM lineitem GROUP BY l_returnflag"),
    "sk_universal": (universal, "SELECT l_returnflag, TRUE AS ok FROM lineitem GROUP BY l_returnflag"),
    "sk_kmv": (kmv, "SELECT l_returnflag, TRUE AS ok FROM lineitem GROUP BY l_returnflag"),
    "sk_top_states": (top_states, "SELECT CAST(least(5, count(DISTINCT o_orderstatus || '/' || o_orderpriority)) AS BIGINT) AS items, TRUE AS ok FROM orders"),
    **{f"view_sliding_{name}": (_slid(fn), _slid_sql(fn)) for name, fn in (
        ("sum", "sum"), ("count", "count"), ("min", "min"), ("max", "max"), ("avg", "avg"), ("increase", "rise"), ("increase_extrapolated", "increase"), ("rate", "rate"), ("irate", "irate"),
    )},
    "view_rollup": (rolled, f"SELECT event_type, CAST(ceil(epoch_us(ts) // 1000 / {WIDTH}.0) * {WIDTH} AS BIGINT) AS \"end\", count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2"),
    "view_current_topk": (population, "SELECT event_type, user_id, value FROM (SELECT event_type, user_id, arg_max(value, ts) AS value FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) <= 3"),
    "join_certified_semi": (certified, "SELECT o_orderkey FROM orders"),
    "fn_spellings": (spellings, _SPELLINGS),
    "fn_in_frame": (framed, "SELECT event_id, coalesce(lag(value) OVER w, 0) AS a, CAST(0 AS DOUBLE) AS b, coalesce(lead(value, 2) OVER w, -1) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"),
    "fn_correlation": (correlated, "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(NULL AS DOUBLE) AS none FROM lineitem GROUP BY l_returnflag"),
    "fn_collection_shims": (shimmed, "SELECT n_nationkey, n_nationkey AS k, n_regionkey AS r, 0 AS z, n_regionkey AS a, regexp_replace(n_name, '[A-M]', '#') AS f FROM nation"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
