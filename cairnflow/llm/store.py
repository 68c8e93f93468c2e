"""Cutting lineage: results kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode gets one new temporary folder per application; a cluster
    gets an error, as a folder of one machine would hold a part of the rows only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if (set_ := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _own[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as parquet and read again."""
    return Scratch(df.sparkSession).stored(df)


class Scratch:
    """Intermediate results of one job, which are deleted when the result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)
        self.paths: list[str] = []
        self.tables: list[str] = []

    def new_path(self, name: str = "t") -> str:
        self.paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def stored(self, df: DataFrame) -> DataFrame:
        to = self.new_path()
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self) -> None:
        """Deletes all that this object wrote."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths, self.tables = [], []
