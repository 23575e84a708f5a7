from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlight.streaming import windows
from ledgerlight.streaming.incremental import Ledger, landed, price_changes

ROW = "tran_id long, filer_id string, donor_id string, contributor_payee string, tran_date date, amount decimal(18,2), tran_type string, sub_type string"
BATCH = f"{ROW}, seq long, gone boolean"


def row(tran_id, day, amount, seq=0, gone=False):
    return (tran_id, "f", "d", "Ann", day, Decimal(amount), "C", "Cash Contribution", seq, gone)


def test_late_corrections_rebuild_their_years_only(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", ROW)
    land = f"{tmp_path}/landed"
    d = date(2020, 5, 1)
    spark.createDataFrame([row(1, d, 10), row(2, date(2021, 5, 1), 20), row(2, date(2021, 5, 1), 25, 1)], BATCH).coalesce(1).write.parquet(land)
    stream = landed(spark, land, BATCH, 1)
    ledger.run(stream, f"{tmp_path}/checkpoint", deleted="gone").awaitTermination()
    sums = lambda: {r.yr: r.total for r in ledger.sums().groupBy("yr").agg(F.sum("total").alias("total")).collect()}
    assert sums() == {2020: 10, 2021: 25}
    spark.createDataFrame([row(1, date(2022, 1, 1), 11, 2), row(2, None, 25, 3, True)], BATCH).coalesce(1).write.mode("append").parquet(land)
    for _ in range(2):  # the second run finds nothing new
        ledger.run(landed(spark, land, BATCH, 1), f"{tmp_path}/checkpoint", deleted="gone").awaitTermination()
        assert sums() == {2022: 11}
    again = spark.createDataFrame([row(1, date(2022, 1, 1), 12, 4)], BATCH)
    assert price_changes(ledger.rows(), again).first().new_amount == 12
    assert ledger.apply(again) == [2022] and ledger.apply(again) == [2022] and sums() == {2022: 12}


def test_a_batch_that_fails_between_rows_and_sums_is_made_good(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", ROW)
    one = lambda *rows: spark.createDataFrame(list(rows), BATCH)
    ledger.apply(one(row(1, date(2020, 5, 1), 10), row(2, date(2021, 5, 1), 20)))
    real, calls = ledger._replace, []

    def fails(df, name, years):
        calls.append(name)
        if name == "sums":
            raise OSError("lost")
        real(df, name, years)

    ledger._replace = fails
    moved = one(row(1, date(2022, 5, 1), 11, 1))
    try:
        ledger.apply(moved)
    except OSError:
        ledger._replace = real
    assert calls == ["rows", "sums"]
    ledger.apply(moved)  # the year that the row has left is known no more from the rows
    assert {r.yr: r.total for r in ledger.sums().collect()} == {2021: 20, 2022: 11}


def test_windows_over_a_stream_match_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    stream = windows.deduplicated(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), late="1 hour")
    out = windows.tumbling(stream, "1 hour")
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.n) for r in spark.table("tumbled").collect()}
    want = {(r.window_start, r.n) for r in windows.tumbling(windows.timed(events)).collect()}
    assert got and got <= want and len(got) >= len(want) - 2


def test_sessions(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0), 1.0), (1, datetime(2024, 1, 1, 0, 20), 1.0), (1, datetime(2024, 1, 1, 1, 0), 1.0), (2, datetime(2024, 1, 1, 0, 0), 1.0)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, value double")
    assert sorted((r.user_id, r.n) for r in windows.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert windows.sliding(df).count() > windows.tumbling(df).count() and windows.daily(df).count() == 1
