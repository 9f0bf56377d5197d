"""From raw documents to packed training sequences, one stage after another.

Every stage works on all rows its predecessor kept, is written as Parquet in the
shared folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advertide.llm.jaccard import joined
from advertide.llm.mixing import mix
from advertide.llm.packing import packed_report
from advertide.llm.secrets import redacted
from advertide.llm.toxicity import without_toxic
from advertide.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer predicts toxic go; its labels are those of the table."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id stays, once; rows without an id stay.

    Near duplicates are at a Jaccard similarity of 0.80 or more of five-word shingles.
    A document is an id with a text: different texts under one id are judged apart,
    by a 64-bit hash of both.
    """
    unit = F.when(F.col("doc_id").cast("long").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text"))
    named = docs.select(unit.alias("doc_id"), "text").where("doc_id is not null")
    near = joined(named, k=5, percent=80).where("component_id <> doc_id")
    near = stage(near.select(F.col("doc_id").alias("_unit"), F.col("component_id").alias("_group")).distinct(), "pipeline-near")
    near = near.union(near.select(F.col("_group").alias("_unit"), "_group").distinct())
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), unit.alias("_unit")).where("_unit is not null").distinct()
    near = near.join(ids, "_unit")
    least = near.groupBy("_group").agg(F.min(F.struct("_id", "_unit"))["_unit"].alias("_unit"))
    others = near.join(least, "_unit", "left_anti").select("_unit")

    rows = docs.select(F.struct(*docs.columns).alias("_row"), unit.alias("_unit"))
    left = rows.where("_unit is not null").join(others, "_unit", "left_anti")
    place = F.row_number().over(Window.partitionBy("_unit").orderBy(F.xxhash64("_row")))
    left = left.withColumn("_place", place).where("_place = 1")
    return left.select("_row.*").unionByName(rows.where("_unit is null").select("_row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; copied examples and clean texts stay as they are."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packed_report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained scores, balanced samples and packing are no SQL; tests hold the stages against plain readings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
