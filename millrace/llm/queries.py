"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm import chunked, counts, lines, neardup, packing, quality, sstable, substrings, topk, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def op1_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sc.new_dir(spark, "sstable")
    manifest = sstable.write_shards(_docs(spark, sf_dir), path, TOKENIZER, end_id=2)
    return sstable.read_shards(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), TOKENIZER, end_id=0, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_docs(spark, sf_dir), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.encode_digests(_docs(spark, sf_dir), TOKENIZER)


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(_docs(spark, sf_dir))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digests(_docs(spark, sf_dir), width=3, percent=85)


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sc.new_dir(spark, "warc")
    pages = sc.columns(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    read = warc.read_archives(warc.write_archives(pages, path, min_bytes=0), payloads=False)
    return read.where("record_type IN ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_docs(spark, sf_dir), width=13)


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sc.columns(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk.search(vectors, k=20, every=20, scale=64.0)


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir)).select("doc_id", *quality.BASE, "base_failed", "kept")


QUERIES = {
    "op1_token_sstable": op1_token_sstable,
    "op2_config_lp_packing": op2_config_lp_packing,
    "op3_token_counts": op3_token_counts,
    "op4_chunked_bpe": op4_chunked_bpe,
    "op5_line_edit_join": op5_line_edit_join,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_difference_cover": op8_difference_cover,
    "op9_maxscore_topk": op9_maxscore_topk,
    "op10_quality_cascade": op10_quality_cascade,
}
ORACLES: dict[str, str] = {
    "op5_line_edit_join": lines.oracle(),
    "op6_hyperminhash": neardup.oracle(3, 85),
    "op8_difference_cover": substrings.oracle(13),
    "op9_maxscore_topk": topk.oracle(20, 20, 64),
    "op10_quality_cascade": quality.oracle(),
}
