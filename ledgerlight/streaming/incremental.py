"""Incremental refresh: micro-batches of landed rows upserted by id, and only the touched years rebuilt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from ..operators.ranking import netted, year_sums
from ..sources.sinks import delete, dirty_years, upsert
from ..store import cut, mark, release


def landed(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Files as they land, a bounded number to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def last_in_batch(rows: DataFrame, key: str = "tran_id", order: str = "seq") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


class Ledger:
    """A silver table of transactions by year and the sums of each year, kept up by micro-batches.

    A batch is idempotent: rows are replaced by id, and years are rebuilt from their rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def rows(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return self._read("rows", empty.withColumn("yr", F.lit(0)))

    def sums(self) -> DataFrame:
        return self._read("sums", year_sums(netted(self.spark.createDataFrame([], self.schema))))

    def _read(self, name: str, like: DataFrame) -> DataFrame:
        try:
            return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return like

    def apply(self, batch: DataFrame, order: str = "seq", deleted: str | None = None) -> list[int]:
        """Upserts one batch and rebuilds the years it touches; returns them.

        Rows whose ``deleted`` flag is set take their id out. Corrections of any age are found by id. The years are noted before anything is
        replaced, and what a batch that failed has noted is rebuilt by the next one, so sums never stay behind their rows.
        """
        since = mark()
        batch = cut(last_in_batch(batch, order=order), "batch")
        old = self.rows()
        noted = self._read("pending", self.spark.createDataFrame([], "yr int"))
        years = sorted({r[0] for r in dirty_years(old, batch).unionByName(noted).distinct().collect()})
        self.spark.createDataFrame([(y,) for y in years], "yr int").coalesce(1).write.mode("append").parquet(f"{self.folder}/pending")
        keep = batch.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else batch
        names = [c for c in old.columns if c != "yr"]
        touched = old.filter(F.col("yr").isin(years))
        now = upsert(delete(touched, batch).select(*names), keep.select(*names)).withColumn("yr", F.coalesce(F.year("tran_date"), F.lit(0)))
        self._replace(cut(now.filter(F.col("yr").isin(years)), "rows"), "rows", years)
        self._replace(year_sums(netted(self.rows().filter(F.col("yr").isin(years)).drop("yr"))), "sums", years)
        self._delete("pending")
        release(self.spark, since)
        return years

    def _delete(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _replace(self, df: DataFrame, name: str, years: list[int]) -> None:
        path = f"{self.folder}/{name}"
        df = cut(df, name)
        df.repartition("yr").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yr").parquet(path)
        left = {r[0] for r in df.select("yr").distinct().collect()}
        for y in set(years) - left:  # a year that lost its last row
            self._delete(f"{name}/yr={y}")

    def run(self, stream: DataFrame, checkpoint: str, order: str = "seq", deleted: str | None = None) -> StreamingQuery:
        """All that has landed, batch by batch, then stops; a later run goes on from there."""
        return (
            stream.writeStream.foreachBatch(lambda df, _: self.apply(df, order, deleted) and None)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def once_per_batch(refresh: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """A refresh run once for a batch that has rows, however many rows changed."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh()

    return run


def touched_cache(cache: DataFrame, batch: DataFrame, key: str = "filer_id") -> DataFrame:
    """The set of touched committees with a batch's added."""
    return cache.select(key).unionByName(batch.select(key)).distinct()


def price_changes(old: DataFrame, batch: DataFrame, key: str = "tran_id") -> DataFrame:
    """The change log of amounts that a batch re-prices in place."""
    a = old.select(key, F.col("amount").alias("old_amount"))
    b = last_in_batch(batch, key).select(key, F.col("amount").alias("new_amount"))
    return a.join(b, key).filter("old_amount <> new_amount")
