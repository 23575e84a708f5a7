from datetime import date
from decimal import Decimal

from ledgerlight import jobs
from ledgerlight.functions import sql
from ledgerlight.functions import values as V

HEAD = "Tran ID,Original ID,Tran Status,Filer ID,Filer,Tran Date,Filed Date,Contributor/Payee,Amount,Sub Type,Zip,Book Type\n"


def test_ingest_resolve_refresh(spark, tmp_path):
    land, silver, gold = (str(tmp_path / x) for x in ("landing", "silver", "gold"))
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "C_a.csv").write_text(
        HEAD + '1,,Original,f1,F,01/05/2020,01/06/2020,"Smith, John",$10.00,Cash Contribution,97201,Individual\n'
        '2,,Original,f1,F,02/05/2021,02/06/2021,John Smith,20,Cash Contribution,97201,Individual\n3,,Original,f1,F,,03/01/2021,Bob,7,Cash Contribution,,Individual\n'
    )
    (tmp_path / "landing" / "C_b.csv").write_text(HEAD + "4,2,Amended,f1,F,02/05/2021,05/06/2021,John Smith,25,Cash Contribution,97201,Individual\n1,,Original,f1,F,01/05/2020,01/06/2020,John Smith,11,Cash Contribution,97201,Individual\n")
    rows = {r.tran_id: r.amount for r in jobs.ingest(spark, land, silver).collect()}
    assert rows == {1: Decimal(11), 3: Decimal(7), 4: Decimal(25)}
    found = jobs.entities(spark, silver, str(tmp_path / "aliases")).collect()
    assert len({r.entity_id for r in found}) == 2
    assert jobs.refresh(spark, silver, gold) == [0, 2020, 2021]
    assert jobs.refresh(spark, silver, gold) == []
    assert jobs.refresh(spark, silver, gold, full=True) == [0, 2020, 2021] and jobs.refresh(spark, silver, gold) == []
    dry = tmp_path / "dry"
    assert len({r.entity_id for r in jobs.entities(spark, silver, str(dry), dry_run=True).collect()}) == 2 and not dry.exists()
    jobs.main(["sql", silver, "select filer_id, sum(amount) as total from transactions group by filer_id"])


def test_sql_functions(spark):
    schema = "filer_id string, tran_date date, amount decimal(18,2), tran_type string, sub_type string"
    rows = [("f", date(2020, 1, 1), Decimal(5), "C", "Cash Contribution"), ("f", date(2020, 1, 1), Decimal(6), "C", "In-Kind Contribution")]
    spark.createDataFrame(rows, schema).createOrReplaceTempView("transactions")
    spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "donor_id string, entity_id string").createOrReplaceTempView("identity")
    sql.register(spark, tables=True)
    got = spark.sql(f"SELECT normalize_label('  {V.POOLED.upper()} '), normalize_label(' a  b'), bucket_label('{V.POOLED_REFUND}'), district_era(2020), cycle_of(DATE'1996-12-01')").first()
    assert tuple(got) == (V.POOLED, "a b", V.POOLED, "2012-2020", 1998)
    assert [tuple(r) for r in spark.sql("SELECT * FROM daily_contributions(DATE'2020-01-01', DATE'2020-12-31')").collect()] == [(date(2020, 1, 1), Decimal(5), 1)]
    assert sorted(r[0] for r in spark.sql("SELECT * FROM donor_group('b')").collect()) == ["a", "b"]
