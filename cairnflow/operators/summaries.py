"""Mergeable summaries as relations: a state is a set of rows, a merge is a sum, a readout is a query.

Spark's own sketches (HLL, KLL, theta, top-k) are used where they exist; DDSketch, Count-Min, Count Sketch, KMV
and the universal sketch are kept as rows, so partial aggregation, spilling and skew handling are Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(states: DataFrame, keys: Sequence[str], cells: Sequence[str], weight: str = "w") -> DataFrame:
    """States of several inputs or windows as one per `keys`; fewer keys than the states have is a rollup."""
    return states.groupBy(*keys, *cells).agg(F.sum(weight).alias(weight))


# DDSketch: counts per logarithmic bucket, relative error alpha


def ddsketch(df: DataFrame, keys: Sequence[str], value: str, alpha: float) -> DataFrame:
    """(keys, sign, bucket, w) counts; nulls and NaN are left out."""
    gamma = (1 + alpha) / (1 - alpha)
    v = F.col(value).cast("double")
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(v)) / math.log(gamma))).cast("int")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("w"))


def ddsketch_quantile(states: DataFrame, keys: Sequence[str], q: float, alpha: float) -> DataFrame:
    """(keys, value) at rank q * (n - 1)."""
    gamma = (1 + alpha) / (1 - alpha)
    w = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    upto = F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("w").over(Window.partitionBy(*keys))
    hit = states.select(*keys, "sign", "bucket", upto.alias("upto"), n.alias("n")).where(F.col("upto") > F.lit(q) * (F.col("n") - 1))
    mid = F.col("b.sign") * 2 * F.pow(F.lit(gamma), F.col("b.bucket")) / (gamma + 1)
    return hit.groupBy(*keys).agg(F.min_by(F.struct("sign", "bucket"), "upto").alias("b")).select(*keys, mid.alias("value"))


# Count-Min and Count Sketch: `depth` rows of `width` counters


def _cells(df: DataFrame, keys: Sequence[str], item: Sequence[str], weight: Column, width: int, depth: int, signed: bool) -> DataFrame:
    rows = df.where(F.expr(" AND ".join(f"`{x}` IS NOT NULL" for x in item))).select(*keys, *item, weight.alias("_w")).groupBy(*keys, *item).agg(F.sum("_w").alias("_w"))
    each = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    h = F.xxhash64("row", *item)
    sign = F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, 1).otherwise(-1) if signed else F.lit(1)
    return each.select(*keys, *item, "row", F.pmod(h, F.lit(width)).cast("int").alias("cell"), sign.alias("_s"), "_w")


def count_min(df: DataFrame, keys: Sequence[str], item: Sequence[str], width: int, depth: int, weight: Column | None = None, signed: bool = False) -> DataFrame:
    """(keys, row, cell, w). signed: a Count Sketch. Weights of a Count-Min must not be negative."""
    c = _cells(df, keys, item, F.lit(1) if weight is None else weight, width, depth, signed)
    return c.groupBy(*keys, "row", "cell").agg(F.sum(F.col("_s") * F.col("_w")).alias("w"))


def estimates(states: DataFrame, items: DataFrame, keys: Sequence[str], item: Sequence[str], width: int, depth: int, signed: bool = False) -> DataFrame:
    """(keys, item, estimate) for the given items: the least counter, or the median of signed ones."""
    asked = _cells(items.dropDuplicates([*keys, *item]), keys, item, F.lit(1), width, depth, signed)
    found = asked.join(states, [*keys, "row", "cell"], "left").withColumn("x", F.coalesce(F.col("w") * F.col("_s"), F.lit(0)))
    return found.groupBy(*keys, *item).agg((F.percentile("x", 0.5) if signed else F.min("x")).alias("estimate"))


# One grid of counters for all groups: a cell is a Count-Min, `spread` rows of `cells` of them


def _in_grid(df: DataFrame, group: Sequence[str], cells: int, spread: int) -> DataFrame:
    each = df.withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return each.withColumn("grid_cell", F.pmod(F.xxhash64(F.lit("grid"), "grid_row", *group), F.lit(cells)).cast("int"))


def shared_grid(df: DataFrame, group: Sequence[str], item: Sequence[str], cells: int, spread: int, width: int, depth: int) -> DataFrame:
    """(grid_row, grid_cell, row, cell, w): frequencies of items in any number of groups in cells * spread * width * depth counters.

    A group's items go to one cell in each row of the grid. Rows are counted per group and item first, so a hot group is a few rows by
    the time it is spread. merged(states, [], GRID) adds grids up; groups aren't kept, so a grid can't be merged across them."""
    known = df.where(F.expr(" AND ".join(f"`{x}` IS NOT NULL" for x in (*group, *item))))
    counted = known.groupBy(*group, *item).agg(F.count("*").alias("_n"))
    # items of different groups in one cell share its counters, so the item alone is hashed there
    return count_min(_in_grid(counted, group, cells, spread), ["grid_row", "grid_cell"], item, width, depth, F.col("_n"))


GRID = ("grid_row", "grid_cell", "row", "cell")


def grid_estimates(states: DataFrame, asked: DataFrame, group: Sequence[str], item: Sequence[str], cells: int, spread: int, width: int, depth: int) -> DataFrame:
    """(group, item, estimate): the least of the grid's rows, never below the true count."""
    places = _in_grid(asked.select(*group, *item).distinct(), group, cells, spread)
    at = estimates(states, places, ["grid_row", "grid_cell"], item, width, depth)
    return places.join(at, ["grid_row", "grid_cell", *item]).groupBy(*group, *item).agg(F.min("estimate").alias("estimate"))


def total(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total weight, exact: any one row of a Count-Min holds it."""
    return states.where("row = 0").groupBy(*keys).agg(F.sum("w").alias("total"))


def l2_norm(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2 norm of the frequencies from a Count Sketch: the median of its rows' norms."""
    rows = states.groupBy(*keys, "row").agg(F.sum(F.col("w").cast("double") * F.col("w")).alias("s"))
    return rows.groupBy(*keys).agg(F.sqrt(F.percentile("s", 0.5)).alias("l2"))


def heavy_hitters(df: DataFrame, keys: Sequence[str], item: str, k: int, weight: str | None = None) -> DataFrame:
    """(keys, item, w): the k heaviest items, ties to the smaller one. Counts are exact; each task keeps partial sums only."""
    sums = df.groupBy(*keys, item).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    order = Window.partitionBy(*keys).orderBy(F.desc("w"), item)
    return sums.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def top_state(item: str, tracked: int = 1000) -> Column:
    """Bounded state of the commonest items; top_merged joins states, and top_read gives the k items with the highest counts."""
    return F.expr(f"approx_top_k_accumulate({item}, {tracked})")


def top_merged(state: str, tracked: int = 1000) -> Column:
    return F.expr(f"approx_top_k_combine({state}, {tracked})")


def top_read(state: str, k: int) -> Column:
    return F.expr(f"approx_top_k_estimate({state}, {k})")


# Distinct counts


def kmv(df: DataFrame, keys: Sequence[str], item: Sequence[str], k: int) -> DataFrame:
    """(keys, h): the k smallest hashes of distinct items. Merging is kmv_merged of a union."""
    hashed = df.where(F.expr(" AND ".join(f"`{x}` IS NOT NULL" for x in item))).select(*keys, F.xxhash64(*item).alias("h"))
    return kmv_merged(hashed, keys, k)


def kmv_merged(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("h")
    return states.dropDuplicates([*keys, "h"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def kmv_estimate(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    share = (F.max("h").cast("double") + 2.0**63) / 2.0**64
    return states.groupBy(*keys).agg(F.when(F.count("*") < k, F.count("*").cast("double")).otherwise((k - 1) / share).alias("distinct"))


def hll(item: str, p: int = 14) -> Column:
    """State of distinct values; hll_merged joins states and hll_estimate reads one."""
    return F.hll_sketch_agg(item, p)


hll_merged, hll_estimate = F.hll_union_agg, F.hll_sketch_estimate


def kll(value: str, k: int = 269) -> Column:
    """State of quantiles by rank error; kll_merged joins states and kll_quantile reads one."""
    return F.expr(f"kll_sketch_agg_double(CAST({value} AS DOUBLE), {k})")


def kll_merged(state: str) -> Column:
    return F.expr(f"kll_merge_agg_double({state})")


def kll_quantile(state: str, q: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double({state}, {q}D)")


def within_ranks(df: DataFrame, key: str, value: str, asked: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """(key, within): whether x of `asked`, one row a key, is between the exact percentiles low and high of the key's values, by counts alone. x must be
    one of the values: such a number isn't below an interpolated percentile if and only if it isn't below the value after it, and so for the upper one."""
    v = F.col(value)
    pairs = df.join(F.broadcast(asked.select(F.col(key).alias("_key"), F.col(x).alias("_x"))), F.col(key).eqNullSafe(F.col("_key")))  # a row a key
    # a percentile of several partitions may not fit a task; counts of rows do
    c = pairs.groupBy(key).agg(F.count(v).alias("_n"), F.count_if(v <= F.col("_x")).alias("_upto"), F.count_if(v < F.col("_x")).alias("_below"))
    last = F.col("_n") - 1
    return c.select(key, ((F.col("_upto") > F.ceil(last * low)) & (F.col("_below") <= F.floor(last * high))).alias("within"))


def theta(item: str) -> Column:
    return F.expr(f"theta_sketch_agg({item})")


def theta_estimate(state: str) -> Column:
    return F.expr(f"theta_sketch_estimate({state})")


# Universal sketch: the heaviest items of nested samples answer any sum of g(frequency)


def universal(df: DataFrame, keys: Sequence[str], item: str, levels: int = 12, k: int = 256, task_rows: int = 500_000) -> DataFrame:
    """(keys, level, item, w): the k heaviest items of each level; level j holds a 2**-j sample of items.

    Counts go to as many tasks as `task_rows` asks for, which keep the k heaviest of theirs before a level's are brought together."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("w"))
    dealt = counts.repartition(max(1, -(-df.count() // task_rows)), item)
    return _heaviest(dealt.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(_depth(item), F.lit(levels))))), keys, item, k)


def _depth(item: str) -> Column:
    """How many levels below the first an item is in: trailing ones of its hash."""
    h = F.xxhash64(F.col(item), F.lit(1))
    return F.length(F.regexp_extract(F.bin(h), "1*$", 0))


def universal_merged(states: DataFrame, keys: Sequence[str], item: str, k: int = 256) -> DataFrame:
    return _heaviest(states.groupBy(*keys, "level", item).agg(F.sum("w").alias("w")), keys, item, k)


def _heaviest(sums: DataFrame, keys: Sequence[str], item: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys, "level").orderBy(F.desc("w"), item)
    return sums.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def universal_sum(states: DataFrame, keys: Sequence[str], item: str, g, levels: int = 12) -> DataFrame:
    """(keys, value): estimate of the sum of g(frequency) over all items."""
    inside = (_depth(item) > F.col("level")).cast("int")
    share = F.when(F.col("level") == levels, F.lit(1)).otherwise(1 - 2 * inside) * F.pow(F.lit(2.0), F.col("level"))
    return states.groupBy(*keys).agg(F.sum(share * g(F.col("w").cast("double"))).alias("value"))
