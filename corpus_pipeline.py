"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes the whole table its predecessor kept, written as Parquet in the shared folder and read again. All but
the last return the columns of documents (``n_chars`` follows the text); the last returns packed pieces.

Defined results: a document with a null or empty text, or with fewer than ten words, goes in the first stage; a copy of
an earlier document loses all its lines in the second and stays as a row with an empty text; rows with equal identifier
and text keep their lines, and near dedup leaves one of them; equal identifiers with different texts and null identifiers
stay rows of their own; texts of any length are taken whole; an empty table gives no rows; other columns, whatever they
are called, are carried along to the last stage, which returns the pieces' columns only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm import lines, neardup, packing, quality, substrings

#: Words that a passage must share with an earlier document to be cut.
PASSAGE_WORDS = 50


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(lines.dedup(docs, counts=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substrings.strip(docs, PASSAGE_WORDS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Near dedup's components and packing can't be expressed in one SQL query; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = sc.new_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = sc.save(stage(spark, docs, sf_dir), f"{path}/{k}-{name}")
    return docs
