"""Streaming windows end with what a batch gives."""

import os

import pytest
from pyspark.sql import functions as F

from cairnflow.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_states_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # a last event far ahead moves the watermark past all windows
    ahead = events.limit(1).withColumn("ts", F.expr("TIMESTAMP '2030-01-01 00:00:00'"))
    events.unionByName(ahead).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    states = windows.tumbling_stream(stream, "ts", "value", ["event_type"], "6 hours", "1 hour")
    windows.keep(states, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("event_type", "end", "n")
    width = 6 * 3600 * 1_000_000
    end = (F.ceil(F.unix_micros("ts") / width) * width / 1000).cast("long")
    want = events.groupBy("event_type", end.alias("end")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sliding_windows_and_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ahead = events.limit(1).withColumn("ts", F.expr("TIMESTAMP '2030-01-01 00:00:00'"))
    events.unionByName(ahead).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    sliding = lambda df: windows.sliding_stream(df, "ts", "value", ["event_type"], "12 hours", "6 hours", "1 hour").select("event_type", "end", "n")
    sessions = lambda df: windows.sessions(df, "ts", ["event_type"], "2 hours", "1 hour")
    for name, build in (("sliding", sliding), ("sessions", sessions)):
        windows.keep(build(stream), str(tmp_path / name), str(tmp_path / f"{name}_check")).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / name)).drop("batch")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(events).collect())), name
