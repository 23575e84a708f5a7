"""Sharding by proportional stratified interleaving, DataFrame functions only.

Rows of each source are put in a seeded random order, the r-th of n rows gets the fractional rank
(2r - 1) / 2n, all rows are ordered by fractional rank, and that order is cut into shards whose row
counts differ by one at most. So every shard holds the sources in the proportions of the corpus.

No source and no rank range is ever sorted in one task: ranks come from counts per (source, bucket of
the hash of id and kept columns) plus a row number inside the bucket, and global positions from counts per bucket of the
fractional rank in the same way, both summed up in levels. The number of buckets follows the number of rows. Only ids, sizes and
checksums are shuffled, never the texts.

Defined cases: a null text has no bytes (size 8, checksum 0) and equals no empty text; a null source is a
stratum of its own; rows repeated in full are rows like others; an empty table gives no rows; further columns
are ignored. Order among rows of one source follows the seeded hash of id, checksum and size. Many rows that are the same in all of
these, such as those without id and text, are dealt over parts of their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import before, small, written

ROWS_PER_BUCKET = 1_024
#: Parts of a bucket: one, and those of many equal rows.
PARTS = 1 << 10


def _buckets(rows: int, rows_per_bucket: int) -> int:
    """Bits of the bucket number: a power of two of buckets, so that each has about rows_per_bucket rows."""
    return max(1, math.ceil(math.log2(max(2, rows / rows_per_bucket))))


def _levels(bits: int) -> int:
    """In how many levels counts of so many buckets are summed up, each of 1024 rows."""
    return max(1, -(-bits // 10))


def interleave(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 20_260,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: the id, the columns of ``keep``, ``stratum``, ``rank``, ``position``, ``shard``, ``slot``.

    ``rank`` counts from 1 within the stratum, ``position`` and ``slot`` from 0 within the corpus and the shard.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    n = docs.count()
    bits = _buckets(n, rows_per_bucket)
    keep = keep or {}
    ident = F.col(id_col).alias("id")
    stratum = F.concat(F.when(F.col(source_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    rows = docs.select(ident, stratum.alias("stratum"), *[c.alias(f"k_{k}") for k, c in keep.items()])
    alike = [c for c in rows.columns if c != "stratum"]
    rows = written(rows.withColumn("h", F.xxhash64(F.lit(seed), *alike)).withColumn("m", F.monotonically_increasing_id()), "strata")
    # Rows that are the same in all that is kept come last in their bucket, and many of them in parts of their own: which is which makes no difference.
    same = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 4 * rows_per_bucket)
    same = small(same.select("h", F.least(F.ceil(F.col("c") / rows_per_bucket), F.lit(PARTS - 1)).alias("parts")))
    rows = rows.join(same, "h", "left").withColumn("part", F.coalesce(1 + F.pmod(F.xxhash64("m"), F.col("parts")), F.lit(0)))
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - bits) * PARTS + F.col("part")).drop("parts", "part")

    # The r-th row of its stratum.
    per_bucket = rows.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("c"))
    per_bucket = before(per_bucket, "b", ["stratum"], "c", _levels(bits + 10)).drop("c")
    ranked = rows.withColumn("i", F.row_number().over(W.partitionBy("stratum", "b").orderBy("h", *alike, "m")).cast("long"))
    ranked = ranked.join(per_bucket, ["stratum", "b"]).withColumn("rank", F.col("before") + F.col("i"))

    # Its place when all rows are ordered by fractional rank.
    odd = F.col("rank") * 2 - 1
    ranked = ranked.withColumn("f", odd / (F.col("of") * 2)).drop("b", "i", "before", "of", "h", "m")
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * (1 << bits)), F.lit((1 << bits) - 1)))
    per_range = before(ranked.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g", [], "c", _levels(bits)).drop("c", "of")
    placed = ranked.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("f", "stratum", "rank")).cast("long"))
    placed = placed.join(per_range, "g").withColumn("position", F.col("before") + F.col("i") - 1)

    shard = F.expr(f"(position * {shards}L) div {max(n, 1)}L")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("id").alias(id_col),
        *[F.col(f"k_{k}").alias(k) for k in keep],
        "stratum",
        "rank",
        "position",
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
    )


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``interleave`` of documents with the size and the checksum of each text; the law held is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = interleave(
        docs,
        shards,
        keep={"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(F.encode(text, "UTF-8"))},
    )
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "position",
    )
