"""The corpus pipeline over ``documents``: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return the columns of documents.

* quality classifier: documents that it rejects go.
* n-gram Jaccard join: the smallest id of each class stays; rows of one id and one text are copies of each other, and one of them stays.
* benchmark decontamination: documents that hold a benchmark item go.
* secret scans: every span found is replaced by ``[redacted]`` in the text, and n_chars follows; no document goes.
* packing: the pieces of all documents that are left.

A row is known by its id and text together (a hash of both, ``_key``), so null ids and ids of several texts lose their copies and leaks like
others, and only those; a null id is smaller than any other. Empty texts pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontam, jaccard, packing, quality, secrets
from ledgerlight.llm.common import free, small, table, written
from ledgerlight.llm.tokens import vocabulary


def _key() -> Column:
    """One number for a row's id and text; never null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` for an operator, with the key as their id."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame, label: str) -> DataFrame:
    """``docs`` without the rows of ``keys`` (doc_id: a row's key); these are broadcast while they are few."""
    key = free("key", docs.columns)
    keys = written(keys.select(F.col("doc_id").alias(key)).distinct(), label)
    return docs.withColumn(key, _key()).join(small(keys), key, "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    return found.filter(F.col(free("predicted", docs.columns)) == 1).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.similar(_named(docs)).filter("n_links > 0").select("doc_id", "class_id")
    members = written(found.distinct(), "members")
    ids = docs.select(_key().alias("_key"), F.col("doc_id").alias("_id")).distinct()
    ids = ids.join(small(members), F.col("_key") == F.col("doc_id"))
    stay = ids.groupBy("class_id").agg(F.min(F.struct("_id", "_key")).alias("m")).select(F.col("m._key").alias("doc_id"))
    left = _without(docs, members.select("doc_id").join(stay, "doc_id", "left_anti"), "copies")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.passages(_named(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"), "leaks")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", mixture_packing),
]

#: SQL can't express the classifier and the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
