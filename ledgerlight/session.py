"""Sessions, and what Python workers need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; a cluster's own settings come from spark-submit."""
    builder = (
        SparkSession.builder.master(master)
        .appName("ledgerlight")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of ``spark``, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlight", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="ledgerlight-code-")) / "ledgerlight.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(to))
    sc._ledgerlight = True
