"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.store import Scratch


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reached.

    Each round hangs the neighbours of a node on the smallest of them (larger ones first, then
    smaller ones), which keeps the components and about halves the depth; labels end as stars.
    Nothing but a count and a hash of the edges reaches the driver.
    """
    old, scratch = None, Scratch(edges.sparkSession)
    now = scratch.stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: from every node to the smaller ones, all hung on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, scratch = scratch, Scratch(edges.sparkSession)
        after = scratch.stored(small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        old.drop()
        last, mark = mark, _mark(after)
        if mark == last:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        now = after


def _mark(edges: DataFrame) -> tuple:
    """Tells edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
