"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, up to which a side is broadcast by hint.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder that its context has; a new local one only for a local master, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.getCheckpointDir():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlight-"))
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; ``release`` deletes what is there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def mark() -> int:
    """Where this driver's list of tables is now, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this driver has put into the shared folder (since a ``mark``); results that read them must have been written."""
    fs = spark._jvm.org.apache.hadoop.fs
    while len(_made) > since:
        p = fs.Path(_made.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, executors may be lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a value."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        size = F.size(c) * 8
    elif isinstance(field.dataType, T.BinaryType | T.StringType):
        size = F.octet_length(c)
    elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        size = F.octet_length(F.to_json(F.struct(c)))
    else:
        size = F.lit(0)
    return F.coalesce(size.cast("long"), F.lit(0)) + 16


def fits(df: DataFrame) -> bool:
    """Whether the rows of ``df`` and their bytes, counted here, are few enough to be broadcast."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(sum((_bytes(f) for f in df.schema.fields), F.lit(0)))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it fits, else as it is."""
    return F.broadcast(df) if fits(df) else df
