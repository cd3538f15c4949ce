"""The corpus pipeline: quality rules, exact and near deduplication, secret removal, packing.

Each stage takes all rows of its predecessor and, but for the last, returns the columns of ``documents``. A
table without rows passes through. What a stage does with nulls, empty and very long texts, ties and repeated
rows is said by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exactdup, neardup, packing, quality, secretscan
from factloom.session import freeze

#: A quality verdict, similarity links and packings are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None
#: Least similarity of the near-dedup stage; the 85 of op5_near_duplicates binds that query only.
NEAR_PERCENT = 80


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The line field is trained on the labelled documents of the corpus."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_field(docs, labels))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exactdup.keep_first(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of similarity 0.8 or more, stays. Rows without a doc_id stay."""
    # the rows that go are few; written first, so that Spark knows their size before it picks the join
    gone = freeze(neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near_gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay, with their new length."""
    cut = secretscan.redact_secrets(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", _quality), ("exact dedup", _exact), ("MinHash near-dedup", _near), ("secret scans", _secrets), ("best-fit packing", _packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
