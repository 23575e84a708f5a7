"""Writers: partitioned shards, upserts, publication and exports. All writes are whole files committed by Spark, or staged and then pointed to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..store import cut, mark, release


def write_shards(df: DataFrame, path: str, date: str = "filed_date") -> None:
    """One partition per year (0 if it can't be told); only the years that come are replaced."""
    rows = df.withColumn("filed_year", F.coalesce(F.year(date), F.lit(0)))
    rows.repartition("filed_year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filed_year").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "tran_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, ids: DataFrame, key: str = "tran_id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def dirty_years(old: DataFrame, new: DataFrame, key: str = "tran_id", date: str = "tran_date") -> DataFrame:
    """Years (0 undated) that a change touches: those of the new rows and of the rows they replace."""
    was = old.join(new.select(key), key, "left_semi").select(F.coalesce(F.year(date), F.lit(0)).alias("yr"))
    return was.unionByName(new.select(F.coalesce(F.year(date), F.lit(0)).alias("yr"))).distinct()


def reload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def merge_details(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Committee details with the former donor lists kept where these are keyed by entity."""
    a = old.select(key, F.col("top_donors").alias("_old"), F.lit(True).alias("_has"))
    keyed = F.coalesce(F.get("_old", F.lit(0))["donor_key"].isNotNull(), F.lit(False))
    return new.join(a, key, "left").withColumn("top_donors", F.when(keyed, F.col("_old")).otherwise(F.col("top_donors"))).drop("_old", "_has")


def merge_log(log: DataFrame, new: DataFrame, key: str = "deletion_id", rows: str = "rows") -> DataFrame:
    """An audit log with its first-seen rows kept and new ones added."""
    both = log.select(key, F.col(rows).alias("_a")).join(new.select(key, F.col(rows).alias("_b")), key, "full")
    none = F.array().cast(log.schema[rows].dataType)
    return both.select(key, F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)).alias(rows))


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def publish(tables: dict[str, DataFrame], folder: str, index: str | None = None, details: str | None = None, key: str = "slug") -> dict:
    """Writes all tables under a new version, checks them, and points to it: readers see all of it or none.

    The index and the details must have the same keys, each once.
    """
    spark, since = next(iter(tables.values())).sparkSession, mark()
    version = uuid.uuid4().hex
    receipt = {"version": version, "tables": {}}
    for name, df in tables.items():
        df = cut(df, "publish")  # what is compared is what is written, even if the source moves
        df.write.parquet(f"{folder}/{version}/{name}")
        (n, h), found = (_digest(x) for x in (df, spark.read.schema(df.schema).parquet(f"{folder}/{version}/{name}")))
        if (n, h) != found:
            raise OSError(f"{name} was not written as it is")
        receipt["tables"][name] = {"rows": n, "digest": h}
    if index and details:
        a, b = (spark.read.parquet(f"{folder}/{version}/{t}").select(key) for t in (index, details))
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count() or a.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError("index and details differ in scope")
    fs, hadoop = _fs(spark, folder)
    staged = hadoop.Path(f"{folder}/.current-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(receipt).encode()))
    out.close()
    # A rename that replaces what is there: readers find the old pointer or the new one.
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, hadoop.Path(f"{folder}/current.json"), _overwrite(spark))
    release(spark, since)
    return receipt


def _overwrite(spark: SparkSession):
    """Hadoop's option of a rename, as the array that the call takes."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark._jvm.java.lang.reflect.Array.newInstance(kind, 1)
    options[0] = next(x for x in kind.getEnumConstants() if x.toString() == "OVERWRITE")
    return options


def _digest(df: DataFrame) -> tuple[int, int]:
    row = F.xxhash64(*df.columns) if df.columns else F.lit(0)
    n, h = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pointer = json.loads(spark.read.text(f"{folder}/current.json").first()[0])
    return spark.read.parquet(f"{folder}/{pointer['version']}/{name}")


def write_csv(df: DataFrame, path: str, order: str = "tran_id") -> None:
    """One gzipped file per range of ids, in order."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_review(pairs: DataFrame, path: str, limit: int = V.REVIEW_ROWS) -> None:
    pairs.orderBy(F.desc("score"), *[c for c in pairs.columns if c != "score"]).limit(limit).write.mode("overwrite").json(path)


def replace_changed(path: str, new: DataFrame, partition: str = "yr", full: bool = False) -> list:
    """Writes only the partitions whose rows differ from those in place (``full``: all of the new ones); returns them."""
    spark, since = new.sparkSession, mark()
    new = cut(new, "totals")
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = new.limit(0)
    columns = [c for c in new.columns if c != partition]

    def digest(df: DataFrame) -> DataFrame:
        return df.groupBy(partition).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("d"), F.count(F.lit(1)).alias("n"))

    a, b = digest(old).alias("a"), digest(new).alias("b")
    changed = [r[0] for r in b.join(a, partition, "left").filter(F.lit(full) | F.expr("not (a.d <=> b.d and a.n <=> b.n)")).select(partition).collect()]  # years
    if changed:
        new.filter(F.col(partition).isin(changed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    release(spark, since)
    return sorted(changed)
