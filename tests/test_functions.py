from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import dates, fuzzy, money, text
from ledgerlight.functions import values as V


def one(spark, expression, *values):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")
    return [r[0] for r in df.select("i", expression.alias("x")).orderBy("i").select("x").collect()]


def test_names(spark):
    assert one(spark, text.normalize_name("a"), "  Ann-Marie  O'Neil, Jr. ", None, "A.B.C", "É_x") == ["ann-marie o'neil jr", "", "a b c", "é_x"]
    assert one(spark, text.canonical_name("a"), "o'brien-smith", "friends of the pac llc", "ACME INC.") == ["O'Brien-Smith", "Friends of the PAC LLC", "Acme Inc"]
    assert one(spark, text.norm_name("a"), "Smith, John Q.", "Acme, Inc.", "Smith, Jr.", "Yes on 1, No on 2", "Friends (1234)", "A, B, C") == ["john q smith", "acme inc", "smith jr", "yes on 1 no on 2", "friends", "a b c"]
    assert one(spark, text.candidate_key("a"), "Sen. Bob L Jones Jr", None) == ["bob jones", ""]
    assert one(spark, text.historical_key("a"), "Wagner Rob", "Robert Wagner") == ["robert wagner"] * 2
    assert one(spark, text.soundex("a"), "Ashcraft", "Tymczak", "", "Pfister-x") == ["a261", "t522", "", one(spark, text.soundex("a"), "Pfisterx")[0]]
    assert one(spark, text.speaking_name("a", ["david", "rob"]), "Gomberg David", "David Gomberg", "Solo") == ["David Gomberg", "David Gomberg", "Solo"]
    assert one(spark, text.committee_norm("a"), "Friends' Fund Committee", "The Miners's PAC") == ["friends fund", "the minerss"]


def test_addresses_and_ids(spark):
    assert one(spark, text.norm_addr("a", "b"), ("12 North Main Street, Apt 4", "97201-1"), ("", "97201"), (None, None)) == ["12 n main st|97201", "", ""]
    assert one(spark, text.norm_employer("a"), "Self-Employed", "N/A", "Acme, Co.") == ["", "", "acme co"]
    assert one(spark, text.clean_id("a"), "123.0", "nan", None, "77") == ["123", "", "", "77"]
    assert one(spark, text.embedded_id("a"), "Friends (1234) ", "none (1)") == ["1234", None]
    assert one(spark, text.slug("a"), "Yes & No!", "x" * 80) == ["yes_no", "x" * 60]
    rows = spark.createDataFrame([("A b",), ("a-b",), ("a b 2",), ("a  b",)], "name string")
    slugs = {r.name: r.slug for r in text.unique_slugs(rows).collect()}
    assert len(set(slugs.values())) == 4 and slugs["A b"] in ("a_b",) or slugs["a  b"] == "a_b"


def test_labels(spark):
    pooled = "miscellaneous  cash contributions\t$100 and under "
    assert one(spark, text.normalize_label("a"), pooled, " A   b ", None) == [V.POOLED, "A b", ""]
    assert one(spark, text.bucket_label("a"), V.POOLED_REFUND.upper(), "x") == [V.POOLED, "x"]
    assert one(spark, text.donor_key("b", "a"), (V.POOLED, "d1"), ("Ann", "d1"), ("Ann", None)) == [f"label:{V.POOLED}", "d1", "name:ann"]
    df = spark.createDataFrame([("ANN LEE",), ("Ann Lee",), ("ann lee",)], "label string")
    assert df.agg(text.display_label("label")).first()[0] == "Ann Lee"
    assert one(spark, text.display_name("a", "b", number=F.col("i")), ("  ", "x"), (None, "")) == ["x", "Committee 1"]
    assert one(spark, text.csv_cell("a"), 'say "x"', "a,b", "plain", None) == ['"say ""x"""', '"a,b"', "plain", ""]
    assert one(spark, text.leadership_tier("a"), "Speaker of the House", "Majority Leader", "Deputy Majority Leader", "President Pro Tempore", None) == [1, 2, 3, 3, 0]
    assert one(spark, text.sub_type_tran_type("a"), "Cash Contribution", "Nonpartisan Activity", "??") == ["C", "OD", ""]
    assert one(spark, text.committee_eligible("a", "b"), ("Ann for Senate", "Individual"), ("Ann for Senate", "Other"), ("Ann", "Political Committee")) == [False, True, True]


def test_money(spark):
    got = one(spark, text.money("a"), "$1,234.50", "($68.50)", "x", None)
    assert [None if x is None else str(x) for x in got] == ["1234.50", "-68.50", None, None]
    assert str(one(spark, text.money("a", 0.0, parentheses=False), "($68.50)")[0]) == "0.00"
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double").select(F.col("a").cast("decimal(18,2)"), F.col("b").cast("decimal(18,2)"))
    assert df.agg(money.known_total("b"), money.known_total("a")).first()[0] is None
    assert spark.range(1).select(money.growth_percent(F.lit(15), F.lit(10)), money.growth_percent(F.lit(1), F.lit(0)), money.growth_percent(F.lit(0), F.lit(0))).first()[:] == (50.0, 999.0, 0.0)
    assert [money.clamp(x, 1, 1000, 100) for x in (None, 0, 5000, 7)] == [100, 1, 1000, 7]
    assert abs(spark.range(1).select(money.deflate(F.lit(100), F.lit(2006))).first()[0] - 100 * 313.689 / 201.6) < 1e-9


def test_dates(spark):
    d = F.to_date("a")
    assert one(spark, dates.cycle(d), "1996-12-01", "1996-11-30", "1997-05-05", "1995-12-31") == [1998, 1996, 1998, 1996]
    assert one(spark, dates.cycle_month(d), "1996-12-01", "1998-11-30") == [1, 24]
    assert spark.range(1).select(dates.primary_date(F.lit(2024)), dates.primary_date(F.lit(2022))).first()[:] == (date(2024, 5, 21), date(2022, 5, 17))
    assert one(spark, dates.parse_date("a"), "2020-01-31", "01/31/2020", "01/31/2020 05:00 PM", "soon", None) == [date(2020, 1, 31)] * 3 + [None] * 2
    assert one(spark, dates.local_date(F.to_timestamp("a")), "2020-01-01 05:00:00") == [date(2019, 12, 31)]
    assert spark.range(1).select(dates.months_between(F.lit(date(2019, 12, 5)), F.lit(date(2020, 2, 1)))).first()[0] == ["2019-12", "2020-01", "2020-02"]


@pytest.mark.parametrize(("a", "b", "score"), [("ann lee", "lee ann", 100.0), ("", "", 100.0), ("abc", "", 0.0), ("abcd", "abxd", 75.0)])
def test_token_sort(a, b, score):
    assert fuzzy.token_sort(a, b) == score


def test_lcs_matches_the_textbook():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs(a, b) == t[-1][-1]
    assert fuzzy.token_set("rob wagner", "wagner rob jr") == 100.0


def test_table_functions(spark):
    from datetime import date

    from ledgerlight.functions import sql

    rows = [(1, "Friends of A", "f1", "a", "Ann", "I", date(2020, 1, 2), 10), (2, "Friends of A", "f1", "b", "Anne", "I", date(2020, 1, 1), 20), (3, "Growers", "f2", "c", "Bob", "B", date(2021, 1, 1), 30), (4, "Growers", "f2", "a", "Ann", "I", date(2022, 1, 1), 40)]
    frame = spark.createDataFrame(rows, "tran_id long, filer string, filer_id string, donor_id string, contributor_payee string, book_type string, tran_date date, amount int")
    views = {
        "transactions": frame.selectExpr("*", "'C' as tran_type", "'Cash Contribution' as sub_type").withColumn("amount", F.col("amount").cast("decimal(18,2)")),
        "identity": spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "donor_id string, entity_id string"),
        "donors": spark.createDataFrame([("a", "Ann", 50, 2), ("b", "Anne", 20, 1), ("c", "Bob", 30, 1)], "donor_id string, display_name string, total_given int, gift_count int"),
        "donor_names": spark.createDataFrame([("b", "Annie"), ("c", "Robert")], "donor_id string, raw_name string"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    sql.register(spark, tables=True, searches=True)
    found = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert sorted(r[-1] for r in found("SELECT * FROM search_transactions('friends', 'ANN', '', '', '', NULL, NULL, NULL, NULL)")) == [1, 2]
    assert sorted(r[-1] for r in found("SELECT * FROM search_transactions('', 'zzz', 'a', 'C', 'I', DATE '2020-01-02', NULL, 10, 39)")) == [1]
    assert [(r[0], int(r[2]), r[3], r[4]) for r in found("SELECT * FROM search_donors(' ann ', 5)")] == [("a", 70, 3, "Annie")]
    assert found("SELECT * FROM search_donors('x', 5)") == [] and len(found("SELECT * FROM search_donors('an', 0)")) == 1
    got = {(r[0], r[1]): (str(r[2]), int(r[3])) for r in found("SELECT * FROM first_gifts(array('b'), array('f1', 'f2'), DATE '2021-12-31')")}
    assert got == {("a", "f1"): ("2020-01-01", 20)}
    assert {r[0] for r in found("SELECT * FROM donor_group('b')")} == {"a", "b"}
    assert len(found("SELECT * FROM daily_contributions(DATE '2020-01-01', DATE '2020-12-31')")) == 2
