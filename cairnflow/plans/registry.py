"""Registered queries: name -> callable, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnflow.plans import operator_queries, relational, series_queries, summary_queries
from cairnflow.sources.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]

def run_sql(text: str) -> Query:
    """A query that reads its tables from sf_dir; names resolve when it is called."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


_TEXTS = {name: (x, x) if isinstance(x, str) else x for name, x in relational.QUERIES.items()}


def queries() -> dict[str, Query]:
    return {name: run_sql(spark_text) for name, (spark_text, _) in _TEXTS.items()} | series_queries.queries() | summary_queries.queries() | operator_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: duck_text for name, (_, duck_text) in _TEXTS.items()} | series_queries.oracle_sql() | summary_queries.oracle_sql() | operator_queries.oracle_sql()
