"""A corpus from documents: toxic texts out, near duplicates down to one, repeats cut, secrets masked, packed.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as parquet in the shared folder and reads again as the next one's docs. All but the last return the columns of
documents. A null text is judged as an empty one and stays null; rows without a doc_id can't be named in a class
and leave with the second stage. Equal rows (of one doc_id and text) are one document from then on; different texts under one doc_id all stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import jaccard_join, packing, secret_scan, suffix_dedup, toxicity
from cairnflow.llm.store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't predict to be toxic."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, "doc_id", "text", model, carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    mark = F.xxhash64("text")  # rows of one id may hold other texts, which are other documents
    in_class = jaccard_join.classes(docs, "doc_id", "text", mark=mark)
    kept = stored(in_class.where("component_id = doc_id").groupBy("doc_id", "mark").agg(F.count("*").alias("rows")))
    marked = docs.withColumn("mark", mark)
    single = marked.join(kept.where("rows = 1"), ["doc_id", "mark"], "left_semi").select(*COLUMNS)
    # only texts of repeated rows are shuffled to reduce equal ones
    again = marked.join(kept.where("rows > 1"), ["doc_id", "mark"], "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS[2:])).alias("least"))
    return single.union(again.select("doc_id", "text", "least.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 100 earlier ones. A character that loses a byte goes as a whole; a
    document that loses all it shows goes as well."""
    blank = docs.withColumn("blank", F.col("text").isNull())
    kept = suffix_dedup.removed(blank, "doc_id", "text", kept="text", carry=(*COLUMNS[2:], "blank")).withColumnRenamed("kept", "rest")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("rest")).when(F.col("blank"), F.lit(None)).otherwise(F.col("rest"))
    return (
        kept.where(~cut | (F.trim(F.translate("rest", "\t\n\r\x0b\x0c", "     ")) != ""))
        .select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length("rest").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind in brackets."""
    return secret_scan.masked(docs.select(*COLUMNS), "doc_id", "text").withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each), ("repeats", cut_repeats), ("secrets", mask_secrets), ("packing", pack)]

#: Stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
