from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import readers, sinks


def test_exports(spark, tmp_path):
    (tmp_path / "C_2020.csv").write_text('Tran ID,Contributor/Payee,Amount,Sub Type\n1.0,Ann,"$1,000.00",Cash Contribution\n')
    (tmp_path / "misc.csv").write_text("Tran ID,Contributor/Payee,Amount,Sub Type\n2,Bob,5,Nonpartisan Activity\n")
    rows = {r.tran_id: r for r in readers.exports(spark, str(tmp_path)).collect()}
    assert rows["1.0"].tran_type == "C" and rows["2"].tran_type == "OD" and rows["2"].source_file == "misc.csv"
    typed = {r.tran_id: r.amount for r in readers.typed(readers.exports(spark, str(tmp_path))).collect()}
    assert typed == {1: Decimal("1000.00"), 2: Decimal("5.00")}
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.sniffed(spark, str(tmp_path)).collect()}
    assert kinds == {"C_2020.csv": "other", "misc.csv": "other"}
    assert readers.shards(spark, str(tmp_path / "none")).count() == 0
    assert readers.blob(spark, str(tmp_path), "none") is None
    with pytest.raises(LookupError):
        readers.blob(spark, str(tmp_path), "none", required=True)


def test_windows():
    assert len(readers.split_window(lambda **w: 10, date(2020, 1, 1), date(2020, 1, 31), 11, ("C",))) == 1
    counted = lambda kind, start, end, band, prefix: (end - start).days + 1
    parts = readers.split_window(counted, date(2020, 1, 1), date(2020, 1, 31), 5, ("C",))
    assert sum(p["n"] for p in parts) == 31 and all(p["n"] < 5 for p in parts)
    deep = readers.split_window(lambda **w: 100 if w["prefix"] is None else 1, date(2020, 1, 1), date(2020, 1, 1), 50, ("C",))
    assert len(deep) == 11 * 36


def test_tiled_days(spark):
    rows = readers.windows(spark, "2020-01-01", "2020-01-10").collect()
    assert [(r.first_day, r.last_day) for r in rows] == [(date(2020, 1, 1), date(2020, 1, 7)), (date(2020, 1, 8), date(2020, 1, 10))]


PAGE = "<table><tr><td>Total Contributions</td><td></td></tr><tr><td>Total EXPENDITURES</td><td>($1,500.25)</td></tr><tr><td>Loans</td><td>-$7</td></tr></table>"


def test_pages(spark):
    assert readers.dollar(PAGE, "total contributions") is None
    assert readers.dollar(PAGE, "Total Expenditures") == -1500.25 and readers.dollar(PAGE, "Loans") == -7
    assert readers.dollar(PAGE, "Loans", start="Total Expenditures", end="nothing") == -7 and readers.dollar(None, "x", 0.0) == 0.0
    df = spark.createDataFrame([("f", PAGE), ("g", None)], "filer_id string, html string")
    got = {r.filer_id: r.out for r in readers.statement_pages(df, {"out": "Total Expenditures"}).collect()}
    assert got == {"f": Decimal("-1500.25"), "g": None}
    rows = readers.listing_pages(df.withColumnRenamed("filer_id", "page"), ["label", "value"], header=False).orderBy("row").collect()
    assert [(r.label, r.value) for r in rows] == [("Total Contributions", ""), ("Total EXPENDITURES", "($1,500.25)"), ("Loans", "-$7")]
    with pytest.raises(ValueError, match="roster"):
        readers.roster(df.withColumnRenamed("filer_id", "page"), ["label", "value"], 10, 20)


def test_writers(spark, tmp_path):
    schema = "tran_id int, tran_date date, filed_date date, amount int"
    old = spark.createDataFrame([(1, date(2020, 1, 1), date(2020, 1, 2), 5), (2, date(2021, 1, 1), None, 6)], schema)
    new = spark.createDataFrame([(2, date(2022, 1, 1), date(2022, 1, 1), 7), (3, None, None, 8)], schema)
    assert {r.yr for r in sinks.dirty_years(old, new).collect()} == {0, 2021, 2022}
    assert {r.tran_id: r.amount for r in sinks.upsert(old, new).collect()} == {1: 5, 2: 7, 3: 8}
    sinks.write_shards(old, f"{tmp_path}/shards")
    sinks.write_shards(new.filter("tran_id = 3"), f"{tmp_path}/shards")
    assert {(r.tran_id, r.filed_year) for r in spark.read.parquet(f"{tmp_path}/shards").collect()} == {(1, 2020), (3, 0)}
    totals = spark.createDataFrame([(2020, "a", 1), (2021, "b", 2)], "yr int, k string, total int")
    assert sinks.replace_changed(f"{tmp_path}/totals", totals) == [2020, 2021]
    assert sinks.replace_changed(f"{tmp_path}/totals", totals.withColumn("total", F.when(F.col("yr") == 2021, 9).otherwise(F.col("total")))) == [2021]
    sinks.write_csv(old, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_publication_is_all_or_nothing(spark, tmp_path):
    index = spark.createDataFrame([("a",), ("b",)], "slug string")
    folder = f"{tmp_path}/published"
    receipt = sinks.publish({"index": index, "details": index.withColumn("x", F.lit(1))}, folder, "index", "details")
    assert receipt["tables"]["index"]["rows"] == 2 and sinks.published(spark, folder, "details").count() == 2
    with pytest.raises(ValueError, match="scope"):
        sinks.publish({"index": index, "details": index.limit(1)}, folder, "index", "details")
    assert sinks.published(spark, folder, "details").count() == 2


def test_details_keep_keyed_lists(spark):
    schema = "slug string, top_donors array<struct<donor_key:string,total:int>>"
    old = spark.createDataFrame([("a", [("d1", 5)]), ("b", [(None, 4)])], schema)
    new = spark.createDataFrame([("a", [(None, 9)]), ("b", [(None, 8)]), ("c", [(None, 7)])], schema)
    assert {r.slug: r.top_donors[0].total for r in sinks.merge_details(old, new).collect()} == {"a": 5, "b": 8, "c": 7}
    log = spark.createDataFrame([(1, ["x"])], "deletion_id int, rows array<string>")
    more = spark.createDataFrame([(1, ["y", "x"]), (2, ["z"])], "deletion_id int, rows array<string>")
    assert {r.deletion_id: r.rows for r in sinks.merge_log(log, more).collect()} == {1: ["x", "y"], 2: ["z"]}
