"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.exactdup import ORACLE as _EXACT
from factloom.llm.hardneg import ORACLE as _HARD
from factloom.llm.neardup import ORACLE as _NEAR
from factloom.llm.suffixdup import ORACLE as _REPEATS
from factloom.llm.vectorcodes import ORACLE as _CODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), digest=True)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import tokenfile as t

    path = t.scratch_path(spark)
    t.write_token_file(table(spark, sf_dir, "documents"), path)
    return t.read_token_file(spark, path, ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.pii import digest, personal_data

    return digest(personal_data(table(spark, sf_dir, "documents")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.htmltree import extract, train_model

    pages = table(spark, sf_dir, "pages")
    return extract(pages, train_model(pages))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.exactdup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secretscan import digest, scan_secrets

    return digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import judge, train_field

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train_field(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.hardneg import mine

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.vectorcodes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.suffixdup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), content=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pieces": op1_pieces, "op2_token_file": op2_token_file, "op3_packing": op3_packing, "op4_pii": op4_pii, "op5_near_duplicates": op5_near_duplicates, "op6_exact_duplicates": op6_exact_duplicates, "op7_secrets": op7_secrets, "op8_quality": op8_quality, "op9_html": op9_html, "op10_token_counts": op10_token_counts, "op11_hard_negatives": op11_hard_negatives, "op12_vector_codes": op12_vector_codes, "op13_repeated_passages": op13_repeated_passages}
ORACLES: dict[str, str] = {"op5_near_duplicates": _NEAR, "op6_exact_duplicates": _EXACT, "op11_hard_negatives": _HARD, "op12_vector_codes": _CODES, "op13_repeated_passages": _REPEATS}
