"""Queries through the operators on order, the registry of aggregates, grids of counters and rates over groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import accuracy, extensions
from cairnflow.operators import ordering
from cairnflow.operators import summaries as sk
from cairnflow.operators import timeseries as ts
from cairnflow.plans import relational
from cairnflow.plans.series_queries import HOUR, START
from cairnflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
DAY = 24 * HOUR


def ranked(spark: SparkSession, d: str) -> DataFrame:
    r = ordering.global_ranks(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_suppkey"])
    return r.select("s_suppkey", F.col("ntile").alias("q"), F.round("percent_rank", 9).alias("p"), F.round("cume_dist", 9).alias("c"))


def ranked_in_flags(spark: SparkSession, d: str) -> DataFrame:
    """Ranks in three groups of any size, which the windows of the SQL would put into a task each."""
    more = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    r = ordering.ranks_in_groups(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", *more), ["l_returnflag"], "l_quantity", more)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.col("row_number").alias("rn"), F.col("rank").alias("rk"), F.col("dense_rank").alias("dr"))


def earlier_purchase(spark: SparkSession, d: str) -> DataFrame:
    """The purchase before each error of a user that has one."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kinds = {k: e.where(F.col("event_type") == k).drop("event_type") for k in ("error", "purchase")}
    bought = kinds["purchase"].select("user_id", "ts", "event_id", F.col("event_id").alias("before"))
    return ordering.asof(kinds["error"], bought, ["user_id"], "ts", ["before"], "event_id").where("before IS NOT NULL").select("event_id", "before")


def extended(spark: SparkSession, d: str) -> DataFrame:
    got = extensions.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], g=("geometric_mean", "l_quantity"), h=("harmonic_mean", "l_quantity"), w=("weighted_mean", "l_discount", "l_quantity"))
    return got.select("l_returnflag", *[F.round(c, 6).alias(c) for c in "ghw"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Prices paid per priority, one sample a day: its unique key is (o_orderpriority, day)."""
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("day")
    return table(spark, d, "orders").groupBy("o_orderpriority", day).agg(F.floor(F.sum("o_totalprice") / 1000).cast("double").alias("value"))


_SAMPLES = "s AS (SELECT o_orderpriority, epoch_ms(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS ts, floor(sum(o_totalprice) / 1000) AS value FROM orders GROUP BY 1, 2)"
AT = 820_454_400_000  # 1996-01-01T00:00:00Z
YEAR = 365 * DAY


def grouped(kind: str) -> Query:
    return lambda spark, d: ts.over_groups(_samples(spark, d), ["o_orderpriority"], ["o_orderpriority", "day"], "day", "value", kind, YEAR, AT).withColumn("value", F.round("value", 6))


def _grouped_sql(kind: str) -> str:
    per = YEAR / 1000 if kind == "rate" else 1
    return f"""WITH {_SAMPLES}, w AS (SELECT *, lag(value) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS p FROM s WHERE ts > {AT - YEAR} AND ts <= {AT}),
    a AS (SELECT o_orderpriority, count(*) AS n, min(ts) AS ft, max(ts) AS lt, arg_min(value, ts) AS fv, arg_max(value, ts) - arg_min(value, ts) + coalesce(sum(p) FILTER (value < p), 0) AS change FROM w GROUP BY 1),
    b AS (SELECT *, (lt - ft) / 1000.0 AS span, (lt - ft) / 1000.0 / (n - 1) AS each, (ft - {AT - YEAR}) / 1000.0 AS x, ({AT} - lt) / 1000.0 AS y FROM a WHERE n >= 2),
    c AS (SELECT *, CASE WHEN x >= 1.1 * each THEN each / 2 ELSE x END AS x1, CASE WHEN y >= 1.1 * each THEN each / 2 ELSE y END AS y1 FROM b)
    SELECT o_orderpriority, round(change * (span + y1 + CASE WHEN change > 0 AND fv >= 0 THEN least(x1, span * fv / change) ELSE x1 END) / span / {per}, 6) AS value FROM c"""


def trailing(spark: SparkSession, d: str) -> DataFrame:
    """The day up to the bound evaluation time, with the time itself and without its start."""
    e = table(spark, d, "events")
    return ts.trailing(e, "ts", DAY, START + 10 * DAY).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


def shared_grid(spark: SparkSession, d: str) -> DataFrame:
    """Events of users per type from one grid, of states per day: never below the exact counts, and within the bound of all events."""
    e = table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    width, depth = accuracy.count_min_size(accuracy.Target(0.01, 0.001))
    shape = (64, 4, width, depth)
    halves = [sk.shared_grid(e.where(F.dayofmonth("day") % 2 == i), ["event_type"], ["user_id"], *shape) for i in (0, 1)]
    states = sk.merged(halves[0].unionByName(halves[1]), [], sk.GRID)
    exact = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    got = sk.grid_estimates(states, exact, ["event_type"], ["user_id"], *shape).join(exact, ["event_type", "user_id"])
    bound = e.groupBy().agg((F.count("*") * 0.01).alias("bound"))  # one row
    return got.join(F.broadcast(bound)).select("event_type", "user_id", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.col("bound"))).alias("ok"))


QUERIES: dict[str, tuple[Query, str]] = {
    "win_rank_family": (ranked_in_flags, relational.QUERIES["win_rank_family"]),
    "win_bonus_ntile": (ranked, "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS p, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS c FROM supplier"),
    "bonus_asof": (earlier_purchase, "SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts"),
    "agg_extension": (extended, "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g, round(count(*) / sum(1 / l_quantity), 6) AS h, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS w FROM lineitem GROUP BY l_returnflag"),
    "sql_group_rate": (grouped("rate"), _grouped_sql("rate")),
    "sql_group_increase": (grouped("increase"), _grouped_sql("increase")),
    "sql_trailing_window": (trailing, f"SELECT event_type, count(*) AS n, min(event_id) AS least FROM events WHERE epoch_us(ts) > {(START + 9 * DAY) * 1000} AND epoch_us(ts) <= {(START + 10 * DAY) * 1000} GROUP BY event_type"),
    "sk_shared_grid": (shared_grid, "SELECT event_type, user_id, TRUE AS ok FROM events GROUP BY ALL"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
