"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..store import cut as written
from ..store import fits, fresh_path, small

__all__ = ["before", "fits", "free", "fresh_path", "small", "table", "written"]

#: Rows of a table of counts that one task runs through at the most, at either of two levels.
CHUNK = 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: list[str]) -> str:
    """``name``, behind as many underscores as make it none of ``taken``."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = f"_{name}"
    return name


def before(counts: DataFrame, order: str, by: list[str], n: str, levels: int = 2, chunk: int = CHUNK) -> DataFrame:
    """``counts`` (a row for each group ``by`` and whole number ``order`` from 0) with ``before``, the sum of ``n`` over the rows of the group that
    come before, and ``of``, that over all of them.

    In ``levels``: chunks of ``chunk`` numbers are summed inside, and their sums are run through in the same way, so a task has a chunk's rows, or
    of a group one for ``chunk ** (levels - 1)`` numbers.
    """
    if levels == 1:
        whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        return counts.withColumn("before", F.sum(n).over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)).withColumn("of", F.sum(n).over(whole))
    counts = counts.withColumn("_c", F.expr(f"{order} div {chunk}").cast("long"))
    sums = before(counts.groupBy(*by, "_c").agg(F.sum(n).alias("_s")).withColumnRenamed("_c", "_d"), "_d", by, "_s", levels - 1, chunk)
    inside = F.sum(n).over(W.partitionBy(*by, "_c").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    same: Column = F.col("l._c") == F.col("r._d")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    left = counts.withColumn("_i", inside).alias("l")
    return left.join(sums.alias("r"), same).select(*[f"l.{c}" for c in counts.columns if c != "_c"], (F.col("_i") + F.col("r.before")).alias("before"), "of")
