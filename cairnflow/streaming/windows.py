"""Window states from streams: watermarked tumbling windows, kept per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling_stream(stream: DataFrame, time: str, value: str, labels: list[str], width: str, late: str) -> DataFrame:
    """Left-open windows (end - width, end] of a stream with states that merge. Rows later than `late` are dropped.

    Spark's windows are closed on the left, so times are moved by a microsecond."""
    moved = stream.withColumn("_moved", F.col(time).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_moved", late)
    states = moved.groupBy(F.window("_moved", width), *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return states.select(*labels, (F.unix_millis(F.col("window.end"))).alias("end"), "n", "total", "low", "high")


def sliding_stream(stream: DataFrame, time: str, value: str, labels: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Windows of `width` every `slide`."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, width, slide), *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*labels, F.col("window.end").alias("end"), "n", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions that end after `gap` without an event."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keep(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended to a folder, a micro-batch at a time, until all input that is there now is read."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return states.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()
