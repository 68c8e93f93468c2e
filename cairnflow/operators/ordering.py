"""Operators on order that don't put a table, or a hot key, into one task: ranks over all rows and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_ranks(df: DataFrame, by: str, then: Sequence[str] = (), tiles: int = 4, parts: int = 200) -> DataFrame:
    """Adds row_number, ntile, percent_rank and cume_dist over all rows by a numeric column and further ones; nulls first.

    Rows are dealt to at most `parts` ranges of `by`, ranked there, and moved up by the rows of the ranges before. The ranges'
    bounds, from approximate quantiles, only balance the work: ranks are exact for any bounds. Rows with one value of `by` meet in one range."""
    bounds = sorted(set(df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []  # fewer than `parts` numbers
    x = F.col(by).cast("double")
    place = F.when(x.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b < x)))
    dealt = df.withColumn("_part", place)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*[F.asc_nulls_first(c) for c in (by, *then)])
    ranked = dealt.select("*", F.row_number().over(inside).alias("_r"), F.rank().over(inside).alias("_first"), F.count("*").over(inside).alias("_peers"))
    moved = ranked.join(F.broadcast(starts), "_part")  # at most `parts` + 1 rows
    n, r = F.col("_all"), F.col("_start") + F.col("_r")
    small, larger = F.floor(n / tiles), n % tiles  # the first `larger` tiles have a row more
    edge = larger * (small + 1)
    tile = F.when(r <= edge, F.floor((r - 1) / (small + 1))).otherwise(larger + F.floor((r - 1 - edge) / F.greatest(small, F.lit(1)))) + 1
    return moved.select(
        *df.columns, r.alias("row_number"), tile.cast("int").alias("ntile"),
        F.coalesce(F.try_divide(F.col("_start") + F.col("_first") - 1, n - 1), F.lit(0.0)).alias("percent_rank"), ((F.col("_start") + F.col("_peers")) / n).alias("cume_dist"),
    )


def ranks_in_groups(df: DataFrame, keys: Sequence[str], by: str, then: Sequence[str], parts: int = 200, cuts: int = 24, task_rows: int = 500_000) -> DataFrame:
    """Adds row_number by `by` and `then`, and rank and dense_rank by `by` alone, in each group of `keys`; nulls first. For groups larger than a task.

    Ranges of `by` are dealt as in global_ranks, but a value that bounds a range is a range by itself, and such ones are cut again by the first of
    `then`, which must be a number, into some `cuts` parts; so the number of ranges is bounded. They are ranked apart and moved up by what stands before, so ranks are
    exact for any bounds. Rows with one value of both columns meet in one range."""
    if df.schema[by].dataType.simpleString() not in ("tinyint", "smallint", "int", "float", "double"):
        raise ValueError(f"{by} must be a number that a double holds")
    found = df.approxQuantile([by, then[0]], [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [[], []]  # fewer than 2 * `parts` numbers
    each = max(1, parts // cuts)
    first, second = (F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>") for bounds in (sorted(set(found[0])), sorted(set(found[1]))[each - 1 :: each]))
    x, y = F.col(by).cast("double"), F.col(then[0]).cast("double")
    below = lambda bounds, c: F.size(F.filter(bounds, lambda b: b < c))
    own = F.coalesce(F.array_contains(first, x), F.lit(False))
    place = F.when(x.isNull(), F.lit(-1)).otherwise(2 * below(first, x) + own.cast("int"))
    cut = F.when(own & y.isNotNull(), below(second, y)).otherwise(F.lit(-1))
    dealt = df.withColumn("_place", place).withColumn("_cut", cut)
    distinct = dealt.groupBy(*keys, "_place", "_cut", by).agg(F.count("*").alias("_n"))
    sizes = distinct.groupBy(*keys, "_place", "_cut").agg(F.sum("_n").alias("_n"), F.count("*").alias("_values"))
    upto = Window.partitionBy(*keys).orderBy("_place", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    placed = Window.partitionBy(*keys).orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
    head = F.row_number().over(Window.partitionBy(*keys, "_place").orderBy("_cut"))
    once = sizes.withColumn("_values", F.when(head == 1, F.col("_values")).otherwise(0))  # the cuts of a range have the same value
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = once.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_place").alias("_at"), F.col("_cut").alias("_sub"),
                         zero(F.sum("_n").over(upto)).alias("_start"), zero(F.sum("_n").over(placed)).alias("_before"), zero(F.sum("_values").over(placed)).alias("_dense"))
    tasks = max(1, -(-df.count() // task_rows))
    inside = Window.partitionBy(*keys, "_place", "_cut")
    rows, values = inside.orderBy(*[F.asc_nulls_first(c) for c in (by, *then)]), inside.orderBy(F.asc_nulls_first(by))
    ranked = dealt.repartition(tasks, *keys, "_place", "_cut").select("*", F.row_number().over(rows).alias("_r"), F.rank().over(values).alias("_rank"), F.dense_rank().over(values).alias("_d"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    moved = ranked.join(F.broadcast(starts), [*same, F.col("_place") == F.col("_at"), F.col("_cut") == F.col("_sub")])
    return moved.select(*df.columns, (F.col("_start") + F.col("_r")).alias("row_number"), (F.col("_before") + F.col("_rank")).alias("rank"), (F.col("_dense") + F.col("_d")).alias("dense_rank"))


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, take: Sequence[str], tie: str, bucket: int = 86_400) -> DataFrame:
    """Rows of left with the columns `take` of the latest row of right with equal keys and a strictly smaller time, null if there is none;
    among rows of one time the greatest `tie` counts. Rows whose key or time is null find none.

    Keys are cut into buckets of seconds, so that a hot key is many small groups: a bucket is read in the order of time, and what the buckets
    before left over comes from one row a bucket."""
    at = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (bucket * 1_000_000))
    last = F.struct(*take)
    known = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in (*on, time)))
    seen = right.where(known).select(*on, time, at.alias("_bucket"), last.alias("_right"), F.col(tie).alias("_tie"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_left"))
    asked = left.select(*on, time, at.alias("_bucket"), F.lit(None).cast(seen.schema["_right"].dataType.simpleString()).alias("_right"), F.lit(None).cast(seen.schema["_tie"].dataType).alias("_tie"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"))
    rows = asked.unionByName(seen)
    # at one time the asking row stands before those of the right side, as only earlier ones count
    order = Window.partitionBy(*on, "_bucket").orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_here", F.last("_right", ignorenulls=True).over(order)).where("_side = 0")
    left_over = seen.groupBy(*on, "_bucket").agg(F.max_by("_right", F.struct(time, "_tie")).alias("_right"))
    buckets = within.select(*on, "_bucket").where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in on))).distinct().join(left_over, [*on, "_bucket"], "full")
    earlier = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*on, "_bucket", F.last("_right", ignorenulls=True).over(earlier).alias("_before"))
    found = within.join(carried, [*on, "_bucket"], "left").withColumn("_found", F.when(known, F.coalesce("_here", "_before")))
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(f"{c}_right" if c in left.columns else c) for c in take])
