"""Tumbling-window states, kept in a table and read by many queries.

A state belongs to a window (end - width, end] of the epoch's grid. Sums, counts and extremes merge by themselves, counters
in order of time. A sliding window of W ending at t is the merge of the W / width states that end in (t - W, t].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators.timeseries import Series, Times, Vector, divide, extrapolated, moment, windows


def window_end(ts: Column, width: int) -> Column:
    return F.ceil(ts / width) * width


def tumbling(s: Series, width: int) -> DataFrame:
    """(labels, end, n, total, low, high, ft, fv, lt, lv, pt, pv, rise): exact states of every window that has samples. pt and pv
    are the last sample but one."""
    end = window_end(F.col("ts"), width)
    order = Window.partitionBy(*s.labels, "end").orderBy(moment(s.df), "value")
    before = F.lag("value").over(order)
    step = F.col("value") - F.col("_p")
    rise = F.when(F.col("_p").isNull(), 0.0).when(step < 0, F.col("value")).otherwise(step)
    rows = s.df.withColumn("end", end).withColumn("_p", before).withColumn("_pt", F.lag("ts").over(order)).withColumn("_rise", rise).withColumn("_at", F.row_number().over(order))
    return rows.groupBy(*s.labels, "end").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min("ts").alias("ft"), F.min_by("value", "_at").alias("fv"), F.max("ts").alias("lt"), F.max_by("value", "_at").alias("lv"),
        F.max_by("_pt", "_at").alias("pt"), F.max_by("_p", "_at").alias("pv"), F.sum("_rise").alias("rise"),
    )


READ = {"sum": lambda: F.sum("total"), "count": lambda: F.sum("n").cast("double"), "min": lambda: F.min("low"), "max": lambda: F.max("high"), "avg": lambda: F.sum("total") / F.sum("n")}


def sliding(states: DataFrame, labels: Sequence[str], width: int, times: Times, window: int, fn: str) -> Vector:
    """sum, count, min, max, avg, rate, increase (both extrapolated), rise (increase as it was seen) or irate over the last `window`, from
    states. The window and the evaluation grid must be multiples of the width."""
    if window % width or times.start % width or (times.step % width and times.end > times.start):
        raise ValueError("the window and the evaluation times must lie on the states' grid")
    s = Series(states.withColumnRenamed("end", "ts"), tuple(labels))
    if fn in READ:
        return Vector(windows(s, times, window).groupBy(*labels, "t").agg(READ[fn]().alias("value")), s.labels)
    order = Window.partitionBy(*labels).orderBy("ts")
    s = Series(s.df.where((F.col("ts") > times.start - window) & (F.col("ts") <= times.end)).withColumn("_lv", F.lag("lv").over(order)).withColumn("_lt", F.lag("lt").over(order)).withColumn("_end", F.lag("ts").over(order)), s.labels)
    w = windows(s, times, window)
    inner = F.col("_end") > F.col("open")
    if fn == "irate":
        # the sample before the last one may be in an earlier state
        pt, pv = F.coalesce("pt", F.when(inner, F.col("_lt"))), F.coalesce("pv", F.when(inner, F.col("_lv")))
        last = w.groupBy(*labels, "t").agg(F.max_by(F.struct("lt", "lv", pt.alias("pt"), pv.alias("pv")), "ts").alias("_x")).select(*labels, "t", "_x.*").where("pt IS NOT NULL")
        rise = F.when(F.col("lv") < F.col("pv"), F.col("lv")).otherwise(F.col("lv") - F.col("pv"))
        return Vector(last.select(*labels, "t", divide(rise, (F.col("lt") - F.col("pt")) / 1000).alias("value")), s.labels)
    seam = F.when(F.col("fv") < F.col("_lv"), F.col("fv")).otherwise(F.col("fv") - F.col("_lv"))
    change = F.sum(F.col("rise") + F.when(inner, seam).otherwise(0.0))
    if fn == "rise":
        return Vector(w.groupBy(*labels, "t").agg(change.alias("value")), s.labels)
    g = w.groupBy(*labels, "t", "open").agg(F.sum("n").alias("n"), F.min_by("fv", "ft").alias("fv"), F.min("ft").alias("ft"), F.max("lt").alias("lt"), change.alias("change"))
    got = g.select(*labels, "t", extrapolated(fn, window, F.col("change")).alias("value"))
    return Vector(got.where("value IS NOT NULL"), s.labels)


def rollup(states: DataFrame, labels: Sequence[str]) -> DataFrame:
    """States of coarser groups from finer ones. Counters don't merge across groups and are left out."""
    return states.groupBy(*labels, "end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


class ViewStore:
    """States as parquet in a folder, one part per ingestion run (start, end]. Runs must tile what a query reads: neither gaps nor overlaps."""

    def __init__(self, path: str):
        self.path = path

    def append(self, states: DataFrame, start: int, end: int) -> None:
        kept = states.where((F.col("end") > start) & (F.col("end") <= end))
        kept.write.parquet(f"{self.path}/run_start={start}/run_end={end}")

    def read(self, spark, start: int, end: int) -> DataFrame:
        """States of windows that end in (start, end]; a gap between runs is an error, never an empty result."""
        df = spark.read.option("basePath", self.path).parquet(f"{self.path}/run_start=*/run_end=*")
        runs = sorted((r[0], r[1]) for r in df.select("run_start", "run_end").distinct().collect())  # one row per run
        at = start
        for a, b in runs:
            if b <= start or a >= end:
                continue
            if a > at:
                break
            if a < at and at > start:
                raise ValueError(f"two runs hold windows after {a}")
            at = b
        if at < end:
            raise ValueError(f"no states for windows after {at}")
        return df.where((F.col("end") > start) & (F.col("end") <= end)).drop("run_start", "run_end")

    def expire(self, spark, before: int) -> list[int]:
        """Deletes runs that end by `before`; their starts."""
        df = spark.read.option("basePath", self.path).parquet(f"{self.path}/run_start=*/run_end=*")
        gone = [(r[0], r[1]) for r in df.where(F.col("run_end") <= before).select("run_start", "run_end").distinct().collect()]  # one row per run
        for start, end in gone:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_start={start}/run_end={end}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return [start for start, _ in gone]


def certified_semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left whose key is in right; fails when read if a key is missing, which a complete right side rules out."""
    known = right.select(*on).dropDuplicates().withColumn("_hit", F.lit(True))
    missing = F.raise_error(F.lit("a key has no row on the right side")).cast("boolean")
    return left.join(known, list(on), "left").where(F.coalesce("_hit", missing)).drop("_hit")


def latest_per_series(s: Series) -> DataFrame:
    """The current population: each series' latest sample, to be ranked or summed."""
    return s.df.groupBy(*s.labels).agg(F.max_by(F.struct("value", "ts"), moment(s.df)).alias("_last")).select(*s.labels, F.col("_last.value").alias("value"), F.col("_last.ts").alias("ts"))
