"""Jobs for spark-submit: python -m ledgerlight.jobs ingest|resolve|refresh|sql ..."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sql import register
from .functions.text import entity_id
from .operators import dedup, explore, ranking, resolve
from .schema import with_missing
from .sources import readers, sinks
from .store import cut

PARTS = {"raw_name": "contributor_payee", "addr": "addr", "city": "city", "state": "state", "zip": "zip", "employer": "employer", "occupation": "occupation", "cid": "committee_id", "book_type": "book_type"}


def ingest(spark: SparkSession, landing: str, silver: str) -> DataFrame:
    """Landed exports to typed transactions: ids once (the last file's row), superseded versions out, one partition per year."""
    raw = readers.exports(spark, landing)
    raw = raw.toDF(*[re.sub(r"\W+", "_", c) for c in raw.columns])
    raw = with_missing(raw, "original_id", "tran_status", "filer_id", "filer", "tran_date", "filed_date")
    rows = readers.typed(raw.withColumns({"file": F.col("source_file"), "row": F.xxhash64(*[c for c in raw.columns if c != "source_file"]).cast("string")}))
    rows = rows.filter("tran_id is not null")
    rows = dedup.keep_last(rows, "tran_id", ("file", "filed_date", "row")).drop("file", "row")
    left, _ = dedup.drop_superseded(cut(rows, "typed"))
    sinks.write_shards(left, silver)
    return spark.read.parquet(silver)


def entities(spark: SparkSession, silver: str, out: str, dry_run: bool = False) -> DataFrame:
    """Contributors of all transactions to aliases with their entity; a dry run writes nothing."""
    rows = with_missing(spark.read.parquet(silver), *PARTS.values())
    tuples = resolve.contributor_tuples(rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in PARTS.items()]))
    keyed = cut(resolve.keyed(tuples), "tuples")
    found = resolve.clusters(keyed)
    aliases = keyed.join(found, "alias", "left").withColumn("entity_id", F.coalesce("entity_id", entity_id("alias")))
    if dry_run:
        return aliases
    sinks.reload(aliases, out)
    return spark.read.parquet(out)


def refresh(spark: SparkSession, silver: str, gold: str, full: bool = False) -> list:
    """Year sums of netted donor rows: only the years whose sums changed are written, or all of them."""
    rows = with_missing(spark.read.parquet(silver), "donor_id").withColumn("donor_id", F.nullif("donor_id", F.lit("")))
    sums = ranking.year_sums(ranking.netted(rows))
    return sinks.replace_changed(f"{gold}/donor_sums", sums, full=full)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    todo = parser.add_subparsers(dest="job", required=True)
    for name, arguments in (("ingest", ("landing", "silver")), ("resolve", ("silver", "out")), ("refresh", ("silver", "gold")), ("sql", ("silver", "text"))):
        sub = todo.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        if name == "resolve":
            sub.add_argument("--dry-run", action="store_true", help="count entities, write nothing")
        if name == "refresh":
            sub.add_argument("--full", action="store_true", help="write all years")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"ledgerlight {args.job}").getOrCreate()
    if args.job == "ingest":
        print(ingest(spark, args.landing, args.silver).count(), "rows")
    elif args.job == "resolve":
        print(entities(spark, args.silver, args.out, args.dry_run).select("entity_id").distinct().count(), "entities")
    elif args.job == "refresh":
        print("years rebuilt:", *refresh(spark, args.silver, args.gold, args.full))
    else:
        register(spark)
        rows, more = explore.run_sql(spark, args.text, {"transactions": spark.read.parquet(args.silver)})
        rows.show(100, truncate=False)
        print("more rows were cut off" if more else "all rows")


if __name__ == "__main__":
    main()
