"""The queries of the training-data operators over their whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, jaccard, packing, quality, secrets, sharding, tokenio, topk
from .common import table
from .tokens import vocabulary


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op2_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_words")


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbours(table(spark, sf_dir, "conversations"))


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOP_PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_jaccard_classes": op2_jaccard_classes,
        "op3_benchmark_passages": op3_benchmark_passages,
        "op4_secret_spans": op4_secret_spans,
        "op5_preference_pairs": op5_preference_pairs,
        "op6_top_products": op6_top_products,
        "op7_line_crf": op7_line_crf,
        "op8_mixture_packing": op8_mixture_packing,
        "op9_token_files": op9_token_files,
        "op10_stratified_shards": op10_stratified_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_classes": jaccard.SIMILAR_SQL,
        "op3_benchmark_passages": decontam.PASSAGES_SQL,
        "op5_preference_pairs": chat.NEIGHBOURS_SQL,
        "op6_top_products": TOP_PRODUCTS_SQL,
    }
