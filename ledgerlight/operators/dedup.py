"""Versions, duplicates, corrections and differences of row sets. Every choice follows a stated total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in an order (DISTINCT ON)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, key: str = "tran_id", order: tuple[str, ...] = ("batch", "file", "row")) -> DataFrame:
    """The last arrival of each id."""
    return first_by(df, [key], [F.desc(c) for c in order])


def newest_amendments(df: DataFrame, original: str = "original_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, stale ids): of each filer's versions of an original, the newest by filed date, then numeric id."""
    chain = F.coalesce(F.col(original), F.col("tran_id")).alias("chain")
    w = W.partitionBy("filer_id", "chain").orderBy(F.desc_nulls_last("filed_date"), F.desc(F.col("tran_id").try_cast("bigint")))
    rows = df.withColumn("chain", chain).withColumn("_n", F.row_number().over(w))
    return rows.filter("_n = 1").drop("_n", "chain"), rows.filter("_n > 1").select("tran_id")


def apply_deletions(df: DataFrame, original: str = "original_id", status: str = "tran_status", keep: DataFrame | None = None) -> DataFrame:
    """Chains whose newest version is a deletion go whole, but for ids in ``keep``; deletion rows go always."""
    w = W.partitionBy("chain").orderBy(F.asc_nulls_first("filed_date"), F.col("tran_id").try_cast("bigint")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = df.withColumn("chain", F.coalesce(F.col(original), F.col("tran_id"))).withColumn("_gone", F.last(F.coalesce(F.col(status), F.lit("")) == "Deleted").over(w))
    if keep is not None:
        rows = rows.join(keep.select("tran_id", F.lit(True).alias("_kept")), "tran_id", "left")
        rows = rows.withColumn("_gone", F.col("_gone") & F.col("_kept").isNull()).drop("_kept")
    return rows.filter((~F.col("_gone")) & (F.coalesce(F.col(status), F.lit("")) != "Deleted")).select(*df.columns)


def drop_superseded(df: DataFrame, original: str = "original_id", status: str = "tran_status", keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deletions, then originals that an amendment names, then all but the newest amendment: (rows left, ids removed)."""
    left = apply_deletions(df, original, status, keep)
    amended = left.filter(F.col(original).isNotNull() & (F.col(original) != F.col("tran_id"))).select("filer_id", F.col(original).alias("tran_id")).distinct()
    if keep is not None:
        amended = amended.join(keep.select("tran_id"), "tran_id", "left_anti")
    left, _ = newest_amendments(left.join(amended, ["filer_id", "tran_id"], "left_anti"), original)
    removed = df.select("tran_id").join(left.select("tran_id"), "tran_id", "left_anti").distinct()
    return left.select(*df.columns), removed


def live_amended(df: DataFrame, original: str = "original_id", status: str = "tran_status") -> DataFrame:
    """Originals marked amended beside the list of their amendments."""
    amendments = df.filter(F.col(original).isNotNull() & (F.col(original) != F.col("tran_id"))).groupBy(F.col(original).alias("tran_id")).agg(
        F.array_sort(F.collect_list(F.struct("filed_date", F.col("tran_id").alias("id"), "amount"))).alias("amendments")
    )
    return df.filter(F.col(status) == "Amended").join(amendments, "tran_id")


def repriced(old: DataFrame, new: DataFrame, key: str = "tran_id", within: str = "0.005") -> DataFrame:
    """Ids in both with amounts that differ: key, old_amount, new_amount."""
    a = old.groupBy(key).agg(F.max("amount").alias("old_amount"))
    b = new.groupBy(key).agg(F.max("amount").alias("new_amount"))
    return a.join(b, key).filter(F.abs(F.col("new_amount") - F.col("old_amount")) > F.lit(within).cast("decimal(18,4)"))


def difference(ours: DataFrame, theirs: DataFrame, key: str = "tran_id", value: str = "amount") -> DataFrame:
    """Ids that are missing, surplus, or differ in a value, by one full join."""
    a, b = ours.select(key, F.col(value).alias("ours"), F.lit(1).alias("_a")), theirs.select(key, F.col(value).alias("theirs"), F.lit(1).alias("_b"))
    rows = a.join(b, key, "full")
    verdict = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "surplus").when(~F.col("ours").eqNullSafe(F.col("theirs")), "changed")
    return rows.withColumn("verdict", verdict).filter("verdict is not null").select(key, "ours", "theirs", "verdict")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, as often as it lacks them."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def concat(*frames: DataFrame) -> DataFrame:
    """Frames of differing columns, one after another."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_gifts(txn: DataFrame, ids: DataFrame | None = None, donor: str = "donor_id") -> DataFrame:
    """Each donor's first gift to each committee, by date, then id."""
    rows = txn if ids is None else txn.join(ids.select(donor).distinct(), donor, "left_semi")
    return first_by(rows, [donor, "filer_id"], [F.asc_nulls_last("tran_date"), F.asc("tran_id")])


def best_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """Of several links the one that is not rejected, then confirmed, then decided last, then scored highest."""
    return first_by(links, keys, [F.asc(F.col("status") == "rejected"), F.desc(F.col("status") == "confirmed"), F.desc_nulls_last("decided_at"), F.desc_nulls_last("score"), F.asc("link_id")])


def latest_spelling(txn: DataFrame, key: str = "filer_id", name: str = "filer") -> DataFrame:
    """All rows with the latest trimmed name of their id."""
    latest = txn.filter(F.trim(name) != "").groupBy(key).agg(F.max_by(F.trim(name), F.struct("filed_date", "tran_id")).alias("_name"))
    return txn.join(latest, key, "left").withColumn(name, F.coalesce("_name", name)).drop("_name")
