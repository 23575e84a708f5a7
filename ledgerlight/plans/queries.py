"""Queries over the driver's tables, each with the same result as SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions import values as V
from ..operators import dedup, elections, explore, graph, lobby, ranking, reconcile, resolve, timeline
from ..streaming import windows
from .star import MONEY, NETTED, TXN, Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Star], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The digest of a scope whose rows have the hash h.
_DIGEST = "sha256(concat_ws(',', count(*), " + ", ".join(f"sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT))" for k in range(8)) + "))"


# Browsing.
@query(f"""WITH {TXN} SELECT tran_id, tran_date, amount, filer, sub_type FROM txn
WHERE tran_type = 'C' AND tran_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND amount >= 20000
ORDER BY amount DESC NULLS LAST, tran_id DESC LIMIT 100""")
def explore_filter_page(s: Star) -> DataFrame:
    rows = s.txn(filer=True)
    out = explore.page(rows, sort="amount", limit=100, tran_type="C", date_from="1997-01-01", date_to="1998-06-30", amount_least="20000")
    return out.select("tran_id", "tran_date", "amount", "filer", "sub_type")


@query(f"""WITH {TXN} SELECT filer_id, count(*) AS n, CAST(sum(amount) AS {MONEY}) AS total FROM txn
WHERE filer ILIKE '%00001%' AND (part_name ILIKE '%a%e%' OR c_name ILIKE '%a%e%') GROUP BY filer_id""")
def explore_name_search(s: Star) -> DataFrame:
    rows = s.txn(donor=True, filer=True, part=True).withColumns({"filer_canonical": F.lit(None).cast("string"), "contributor_payee_canonical": F.col("part_name")})
    names = s.table("customer").select(F.col("c_custkey").cast("string").alias("donor_id"), "c_name")
    rows = rows.drop("contributor_payee").join(names, "donor_id").withColumnRenamed("c_name", "contributor_payee")
    return explore.narrowed(rows, filer="00001", payee="a%e").groupBy("filer_id").agg(F.count(F.lit(1)).alias("n"), money.total("amount").alias("total"))


@query(f"""WITH {TXN} SELECT sub_type, tran_id, amount FROM txn WHERE sub_type = 'In-Kind Contribution' ORDER BY amount ASC NULLS LAST, tran_id DESC LIMIT 50 OFFSET 25""")
def explore_sub_type_page(s: Star) -> DataFrame:
    return explore.page(s.txn(), sort="amount", ascending=True, limit=50, offset=25, sub_type="In-Kind Contribution").select("sub_type", "tran_id", "amount")


@query("""SELECT s_suppkey AS filer_id, coalesce(nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE NULL END), ''),
  nullif(trim(CASE WHEN s_suppkey % 2 = 0 THEN s_name END), ''), 'Committee ' || CAST(s_suppkey AS VARCHAR)) AS name FROM supplier""")
def explore_display_fallback(s: Star) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_suppkey").alias("filer_id"), F.when(F.col("s_suppkey") % 3 == 0, "  ").alias("a"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("b"))
    return rows.select("filer_id", text.display_name("a", "b", number="filer_id").alias("name"))


@query(f"""WITH {TXN} SELECT tran_id, filed_date, amount FROM txn ORDER BY filed_date DESC NULLS LAST, tran_id DESC, amount DESC LIMIT 200""")
def recent_rows(s: Star) -> DataFrame:
    return s.txn().orderBy(F.desc_nulls_last("filed_date"), F.desc("tran_id"), F.desc("amount")).limit(200).select("tran_id", "filed_date", "amount")


@query("SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY n_regionkey")
def ad_hoc_sql(s: Star) -> DataFrame:
    rows, _ = explore.run_sql(s.spark, "SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY n_regionkey;", {"nation": s.table("nation")})
    return rows


@query("SELECT s_suppkey AS filer_id, CAST(s_suppkey AS VARCHAR) || ',' || chr(34) || s_name || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || CAST(s_nationkey AS VARCHAR) AS line FROM supplier")
def csv_export_lines(s: Star) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_suppkey"), F.concat("s_name", F.lit(', "x"')).alias("n"), "s_nationkey")
    return rows.select(F.col("s_suppkey").alias("filer_id"), F.concat_ws(",", *[text.csv_cell(c) for c in rows.columns]).alias("line"))


@query(f"""WITH {TXN} SELECT filer_id, count(*) AS held FROM txn WHERE tran_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND tran_type IN ('C', 'E')
AND amount BETWEEN 1000 AND 30000 AND upper(label) LIKE 'CUSTOMER#00000%' GROUP BY filer_id""")
def window_census(s: Star) -> DataFrame:
    return reconcile.window_census(s.txn(donor=True), "1998-01-01", "1998-12-31", ["C", "E"], "1000", "30000", "customer#00000")


# Summaries.
@query(f"""WITH {TXN} SELECT tran_type = 'C' AND sub_type = 'Cash Contribution' AS cash, tran_type, count(*) AS n, CAST(sum(amount) AS {MONEY}) AS total FROM txn GROUP BY 1, 2""")
def cash_predicate_split(s: Star) -> DataFrame:
    from ..schema import is_cash_gift

    return s.txn().groupBy(is_cash_gift().alias("cash"), "tran_type").agg(F.count(F.lit(1)).alias("n"), money.total("amount").alias("total"))


_MEASURES = f"""CAST(coalesce(sum(amount) FILTER (WHERE sub_type = 'Cash Contribution'), 0) AS {MONEY}) AS contributions,
CAST(coalesce(sum(amount) FILTER (WHERE sub_type = 'In-Kind Contribution'), 0) AS {MONEY}) AS inkind,
CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'E'), 0) AS {MONEY}) AS expenditures,
CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'OD'), 0) AS {MONEY}) AS other_disbursements, count(*) AS n"""


@query(f"WITH {TXN} SELECT {_MEASURES}, min(tran_date) AS first_date, max(tran_date) AS last_date FROM txn")
def type_split_summary(s: Star) -> DataFrame:
    return timeline.summary(s.txn()).select("contributions", "inkind", "expenditures", "other_disbursements", "n", "first_date", "last_date")


@query(f"WITH {TXN} SELECT strftime(tran_date, '%Y-%m') AS month, {_MEASURES} FROM txn GROUP BY 1")
def monthly_timeline(s: Star) -> DataFrame:
    return timeline.monthly(s.txn()).select("month", "contributions", "inkind", "expenditures", "other_disbursements", "n")


@query(f"WITH {TXN} SELECT filer_id, {_MEASURES} FROM txn GROUP BY 1")
def filer_totals(s: Star) -> DataFrame:
    return timeline.totals_by(s.txn(), "filer_id").select("filer_id", "contributions", "inkind", "expenditures", "other_disbursements", "n")


@query(f"WITH {TXN} SELECT {_MEASURES.replace(', count(*) AS n', '')} FROM txn WHERE strftime(tran_date, '%Y-%m') BETWEEN '1997-03' AND '1998-02'")
def stat_tiles(s: Star) -> DataFrame:
    return timeline.stat_tiles(timeline.monthly(s.txn()), "1997-03", "1998-02").select("contributions", "inkind", "expenditures", "other_disbursements")


@query(f"""WITH {TXN}, t AS (SELECT book_type, outside, CAST(sum(amount) AS {MONEY}) AS total, count(*) AS n FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2)
SELECT book_type || CASE WHEN outside THEN ' (out of state)' ELSE '' END AS label, total, n, CAST(sum(total) OVER (PARTITION BY book_type) AS {MONEY}) AS type_total FROM t""")
def by_type_in_out_state(s: Star) -> DataFrame:
    return timeline.by_type(s.txn(donor=True, filer=True)).select("label", "total", "n", "type_total")


@query(f"""WITH {TXN}, t AS (SELECT book_type, outside, donor_id, CAST(sum(amount) AS {MONEY}) AS total FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY book_type, outside ORDER BY total DESC, donor_id) AS INT) AS rank FROM t
QUALIFY rank <= 5""")
def by_type_top5(s: Star) -> DataFrame:
    return timeline.top_by_type(s.txn(donor=True, filer=True), "donor_id")


@query(f"""WITH {TXN} SELECT filer_id, CAST(year(tran_date) AS INT) AS year,
CAST(sum(CASE tran_type WHEN 'C' THEN amount ELSE -amount END) AS {MONEY}) AS net FROM txn GROUP BY 1, 2""")
def filer_yearly_net(s: Star) -> DataFrame:
    return timeline.yearly_net(s.txn(), "filer_id")


@query(f"""WITH {TXN}, y AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, sum(CASE tran_type WHEN 'C' THEN amount ELSE -amount END) AS net FROM txn GROUP BY 1, 2)
SELECT filer_id, year, CAST(net AS {MONEY}) AS net, CAST(1000 + sum(net) OVER w - net AS {MONEY}) AS opening, CAST(1000 + sum(net) OVER w AS {MONEY}) AS ending
FROM y WINDOW w AS (PARTITION BY filer_id ORDER BY year)""")
def running_balance(s: Star) -> DataFrame:
    return timeline.running_balance(timeline.yearly_net(s.txn(), "filer_id"), opening=F.lit(1000))


_CYCLE = "(year(tran_date) + year(tran_date) % 2 + CASE WHEN month(tran_date) = 12 AND year(tran_date) % 2 = 0 THEN 2 ELSE 0 END)"


@query(f"""WITH {TXN}, r AS (SELECT CAST({_CYCLE} AS INT) AS cycle, tran_date, amount FROM txn),
m AS (SELECT cycle, CAST((year(tran_date) - cycle + 2) * 12 + month(tran_date) - 11 AS INT) AS m, sum(amount) AS total FROM r GROUP BY 1, 2),
l AS (SELECT cycle, max(m) AS last FROM m GROUP BY 1), p AS (SELECT cycle, CAST(unnest(range(1, last + 1)) AS INT) AS m FROM l)
SELECT p.cycle, p.m, CAST(coalesce(total, 0) AS {MONEY}) AS total, CAST(sum(coalesce(total, 0)) OVER (PARTITION BY p.cycle ORDER BY p.m) AS {MONEY}) AS cumulative
FROM p LEFT JOIN m USING (cycle, m)""")
def cumulative_cycle(s: Star) -> DataFrame:
    return timeline.cumulative_cycle(s.txn())


@query(f"""WITH {TXN}, r AS (SELECT {_CYCLE} AS cycle, book_type, amount FROM txn),
t AS (SELECT book_type, CAST(coalesce(sum(amount) FILTER (WHERE cycle = 1998), 0) AS {MONEY}) AS past, CAST(coalesce(sum(amount) FILTER (WHERE cycle = 2000), 0) AS {MONEY}) AS now FROM r WHERE cycle IN (1998, 2000) GROUP BY 1)
SELECT *, round(CAST(past AS DOUBLE) / CAST(sum(past) OVER () AS DOUBLE), 6) AS past_share, round(CAST(now AS DOUBLE) / CAST(sum(now) OVER () AS DOUBLE), 6) AS now_share FROM t""")
def cycle_composition(s: Star) -> DataFrame:
    return timeline.composition(s.txn(donor=True), (1998, 2000))


@query(f"""WITH {TXN}, t AS (SELECT filer_id, book_type, CAST(sum(amount) AS {MONEY}) AS total FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2)
SELECT *, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY filer_id) AS DOUBLE) * 100, 6) AS percent FROM t""")
def type_share_per_filer(s: Star) -> DataFrame:
    return timeline.shares(s.txn(donor=True), "filer_id")


@query(f"""WITH {TXN}, t AS (SELECT strftime(tran_date, '%Y-%m') AS month, book_type AS type, sum(amount) AS total FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2),
b AS (SELECT min(month) AS a, max(month) AS z FROM t),
m AS (SELECT strftime(unnest(generate_series(CAST(a || '-01' AS DATE), CAST(z || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM b)
SELECT m.month, k.type, CAST(coalesce(t.total, 0) AS {MONEY}) AS total FROM m CROSS JOIN (SELECT DISTINCT type FROM t) k LEFT JOIN t ON t.month = m.month AND t.type = k.type""")
def month_by_type(s: Star) -> DataFrame:
    return timeline.month_type_series(s.txn(donor=True), first="1990-01")


_NOW, _BEFORE = ["1998-05", "1998-06"], ["1998-03", "1998-04"]
_IN = lambda m: "(" + ", ".join(f"'{x}'" for x in m) + ")"
_GROWTH = f"""g AS (SELECT filer_id, CAST(coalesce(sum(amount) FILTER (WHERE strftime(tran_date, '%Y-%m') IN {_IN(_NOW)}), 0) AS {MONEY}) AS d60_now,
CAST(coalesce(sum(amount) FILTER (WHERE strftime(tran_date, '%Y-%m') IN {_IN(_BEFORE)}), 0) AS {MONEY}) AS d60_before
FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1)"""


@query(f"""WITH {TXN}, {_GROWTH}, b AS (SELECT filer_id FROM txn GROUP BY 1)
SELECT filer_id, coalesce(d60_now, 0) AS d60_now, coalesce(d60_before, 0) AS d60_before,
CASE WHEN d60_before > 0 THEN round_even((CAST(d60_now AS DOUBLE) - CAST(d60_before AS DOUBLE)) / CAST(d60_before AS DOUBLE) * 100, 1) WHEN d60_now > 0 THEN 999.0 ELSE 0.0 END AS d60_growth
FROM b LEFT JOIN g USING (filer_id)""")
def growth_windows(s: Star) -> DataFrame:
    return timeline.growth(timeline.monthly(s.txn(), "filer_id"), "filer_id", {"d60": (_NOW, _BEFORE)})


@query(f"""WITH {TXN}, {_GROWTH}, r AS (SELECT *, round_even((CAST(d60_now AS DOUBLE) - CAST(d60_before AS DOUBLE)) / CAST(d60_before AS DOUBLE) * 100, 1) AS d60_growth FROM g WHERE d60_now >= 1000 AND d60_before >= 1000)
SELECT filer_id, d60_growth FROM r ORDER BY d60_growth DESC, d60_now DESC, filer_id LIMIT 12""")
def top_growth(s: Star) -> DataFrame:
    rows = timeline.growth(timeline.monthly(s.txn(), "filer_id"), "filer_id", {"d60": (_NOW, _BEFORE)})
    return timeline.top_growth(rows, "filer_id", "d60", 1000).select("filer_id", "d60_growth")


# Rankings.
@query(f"""WITH {NETTED} SELECT CAST(year(tran_date) AS INT) AS yr, filer_id, donor_key, label, CAST(sum(amount) AS {MONEY}) AS total, CAST(sum(gift) AS BIGINT) AS gifts FROM net GROUP BY 1, 2, 3, 4""")
def donor_rows_netted(s: Star) -> DataFrame:
    return ranking.year_sums(ranking.netted(s.txn(donor=True)))


_LEADERS = f"""lead AS (SELECT donor_key, max(CASE WHEN NOT pooled THEN donor_id END) AS donor_id, min(label) AS name, CAST(sum(amount) AS {MONEY}) AS total, CAST(sum(gift) AS BIGINT) AS gifts
FROM net WHERE tran_date BETWEEN DATE '1996-12-01' AND DATE '1998-11-30' GROUP BY 1 HAVING sum(amount) > 0 ORDER BY total DESC, donor_key LIMIT 100)"""
_SCOPE = {"start": "1996-12-01", "end": "1998-11-30"}


@query(f"WITH {NETTED}, {_LEADERS} SELECT *, CAST(row_number() OVER (ORDER BY total DESC, donor_key) AS INT) AS rank FROM lead")
def donor_leaderboard(s: Star) -> DataFrame:
    return ranking.donor_leaderboard(ranking.netted(s.txn(donor=True)), limit=100, **_SCOPE)


@query(f"""WITH {NETTED}, {_LEADERS} SELECT donor_key, CAST(year(tran_date) AS INT) AS year, CAST(sum(amount) AS {MONEY}) AS total FROM net
WHERE tran_date BETWEEN DATE '1996-12-01' AND DATE '1998-11-30' AND donor_key IN (SELECT donor_key FROM lead) GROUP BY 1, 2 HAVING sum(amount) > 0""")
def donor_leaderboard_by_year(s: Star) -> DataFrame:
    return ranking.leaderboard_by_year(ranking.netted(s.txn(donor=True)), limit=100, **_SCOPE)


@query(f"""WITH {NETTED}, y AS (SELECT donor_key, CAST(year(tran_date) AS INT) AS year, min(label) AS name, CAST(sum(amount) AS {MONEY}) AS total FROM net GROUP BY 1, 2 HAVING sum(amount) > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY total DESC, donor_key) AS INT) AS rank FROM y QUALIFY rank <= 50""")
def top_donors_independent_years(s: Star) -> DataFrame:
    return ranking.top_by_year(ranking.netted(s.txn(donor=True)), 50)


@query(f"""WITH {NETTED}, y AS (SELECT filer_id, donor_key, CAST(year(tran_date) AS INT) AS year, CAST(grouping(year(tran_date)) AS INT) AS all_years, CAST(sum(amount) AS {MONEY}) AS total
FROM net GROUP BY GROUPING SETS ((filer_id, donor_key), (filer_id, donor_key, year(tran_date))) HAVING sum(amount) > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY filer_id, all_years, year ORDER BY total DESC, donor_key) AS INT) AS rank FROM y QUALIFY rank <= 10""")
def grouping_sets_all_and_year(s: Star) -> DataFrame:
    return ranking.ranked_sets(ranking.netted(s.txn(donor=True)), 10).drop("name")


@query(f"""WITH {TXN} SELECT filer_id, CAST(sum(amount) AS {MONEY}) AS total, count(*) AS gifts, max(filer) AS name,
CAST(row_number() OVER (ORDER BY sum(amount) DESC, filer_id) AS INT) AS rank FROM txn WHERE sub_type = 'Cash Contribution' AND tran_date BETWEEN DATE '1996-12-01' AND DATE '1998-11-30'
GROUP BY filer_id ORDER BY total DESC, filer_id LIMIT 100""")
def recipient_leaderboard(s: Star) -> DataFrame:
    return ranking.recipient_leaderboard(s.txn(filer=True), start="1996-12-01", end="1998-11-30")


_SOME = list(range(1, 11))


@query(f"""WITH {TXN}, t AS (SELECT lower(trim(part_name)) AS payee_key, min(trim(part_name)) AS name, CAST(sum(amount) AS {MONEY}) AS total, count(*) AS payments FROM txn
WHERE tran_type = 'E' AND filer_id BETWEEN 1 AND 10 AND trim(part_name) <> '' GROUP BY 1 ORDER BY total DESC, payee_key LIMIT 200)
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, payee_key) AS INT) AS rank FROM t""")
def payee_leaderboard(s: Star) -> DataFrame:
    return ranking.payee_leaderboard(s.txn(part=True).withColumnRenamed("part_name", "contributor_payee"), _SOME)


@query(f"""WITH {TXN} SELECT tran_date, CAST(sum(amount) AS {MONEY}) AS total, count(*) AS gifts FROM txn
WHERE sub_type = 'Cash Contribution' AND tran_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND filer_id BETWEEN 1 AND 10 GROUP BY 1""")
def daily_contributions(s: Star) -> DataFrame:
    return ranking.daily_contributions(s.txn(), "1997-01-01", "1997-12-31", _SOME)


_PAIRS = f"""w AS (SELECT donor_key, filer_id, CAST(sum(amount) AS {MONEY}) AS total, min(label) AS name FROM net
WHERE tran_date >= DATE '1998-03-01' AND tran_date < DATE '1998-06-01' AND NOT pooled GROUP BY 1, 2 HAVING sum(amount) > 0),
d AS (SELECT donor_key, min(name) AS name, CAST(sum(total) AS {MONEY}) AS total, count(*) AS committees FROM w GROUP BY 1 ORDER BY total DESC, donor_key LIMIT 10)"""


@query(f"WITH {NETTED}, {_PAIRS} SELECT *, CAST(row_number() OVER (ORDER BY total DESC, donor_key) AS INT) AS rank FROM d")
def pulse_donors(s: Star) -> DataFrame:
    return ranking.pulse_donors(ranking.netted(s.txn(donor=True)), "1998-03-01", "1998-06-01")[0]


@query(f"""WITH {NETTED}, {_PAIRS} SELECT w.*, CAST(row_number() OVER (PARTITION BY w.donor_key ORDER BY w.total DESC, filer_id) AS INT) AS rank
FROM w JOIN d USING (donor_key) QUALIFY rank <= 10""")
def pulse_details(s: Star) -> DataFrame:
    return ranking.pulse_donors(ranking.netted(s.txn(donor=True)), "1998-03-01", "1998-06-01")[1]


_MEMBERS = [str(n) for n in range(1, 41)]
_ONE_OF = "(" + ", ".join(f"'{m}'" for m in _MEMBERS) + ")"


@query(f"""WITH {TXN} SELECT CAST(year(tran_date) AS INT) AS year,
CAST(greatest(coalesce(sum(amount) FILTER (WHERE tran_type = 'C'), 0) - coalesce(sum(amount) FILTER (WHERE tran_type = 'OD'), 0), 0) AS {MONEY}) AS given,
CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'E'), 0) AS {MONEY}) AS received FROM txn WHERE donor_id IN {_ONE_OF} GROUP BY 1""")
def donor_profile_by_year(s: Star) -> DataFrame:
    return ranking.donor_profile_years(s.txn(), _MEMBERS)


@query(f"""WITH {TXN}, t AS (SELECT filer_id, CAST(sum(CASE tran_type WHEN 'C' THEN amount ELSE -amount END) AS {MONEY}) AS total, count(*) FILTER (WHERE tran_type = 'C') AS gifts
FROM txn WHERE tran_type IN ('C', 'OD') AND donor_id IN {_ONE_OF} GROUP BY 1 HAVING total > 0 ORDER BY total DESC, filer_id LIMIT 15)
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, filer_id) AS INT) AS rank FROM t""")
def donor_profile_recipients(s: Star) -> DataFrame:
    return ranking.donor_profile_recipients(s.txn(), _MEMBERS)


@query(f"""WITH {TXN}, m AS (SELECT donor_id, priority, row_number() OVER (PARTITION BY donor_id ORDER BY count(*) DESC, priority) AS k FROM txn GROUP BY 1, 2)
SELECT t.donor_id, CAST(coalesce(sum(amount) FILTER (WHERE sub_type = 'Cash Contribution'), 0) AS {MONEY}) AS total_given,
CAST(coalesce(sum(amount) FILTER (WHERE sub_type = 'In-Kind Contribution'), 0) AS {MONEY}) AS total_inkind, CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'E'), 0) AS {MONEY}) AS total_received,
count(*) FILTER (WHERE tran_type = 'C') AS gift_count, min(tran_date) AS first_date, max(tran_date) AS last_date, max(m.priority) AS priority
FROM txn t JOIN m ON m.donor_id = t.donor_id AND m.k = 1 GROUP BY 1""")
def donor_rollup_mode(s: Star) -> DataFrame:
    return ranking.donor_rollup(s.txn(), ("priority",))


@query(f"""WITH {TXN}, r AS (SELECT brand AS label, donor_id, sum(amount) FILTER (WHERE sub_type = 'Cash Contribution') AS given, count(*) AS n FROM txn GROUP BY 1, 2)
SELECT label, donor_id AS entity_id FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY coalesce(given, 0) DESC, n DESC, donor_id DESC) = 1""")
def label_entities(s: Star) -> DataFrame:
    return ranking.label_entities(s.txn(part=True).withColumnRenamed("brand", "contributor_payee"))


@query(f"""WITH {NETTED} SELECT donor_key, {', '.join(f"CAST(sum(amount) FILTER (WHERE year(tran_date) = {y}) AS {MONEY}) AS c_{y}" for y in range(1996, 2000))}
FROM net WHERE year(tran_date) BETWEEN 1996 AND 1999 GROUP BY 1""")
def pivot_donor_year(s: Star) -> DataFrame:
    rows = ranking.netted(s.txn(donor=True)).withColumn("yr", F.year("tran_date"))
    return timeline.pivoted(rows, "donor_key", "yr", list(range(1996, 2000)))


@query(f"""WITH {NETTED} SELECT donor_key, {', '.join(f"CAST(sum(amount) FILTER (WHERE filer_id = {y}) AS {MONEY}) AS c_{y}" for y in range(1, 5))}, CAST(sum(amount) AS {MONEY}) AS row_total
FROM net WHERE filer_id BETWEEN 1 AND 4 GROUP BY 1 HAVING sum(amount) > 0""")
def pivot_donor_filer(s: Star) -> DataFrame:
    out = timeline.pivoted(ranking.netted(s.txn(donor=True)), "donor_key", "filer_id", [1, 2, 3, 4])
    whole = sum((F.coalesce(f"c_{k}", F.lit(0)) for k in range(1, 5)), F.lit(0)).cast(money.MONEY)
    return out.withColumn("row_total", whole).filter("row_total > 0")


@query(f"""WITH {TXN} SELECT lower(brand) AS key, min(brand) AS name, CAST(sum(amount) AS {MONEY}) AS total FROM txn WHERE year(tran_date) IN (1997, 1998) GROUP BY 1""")
def merged_year_lists(s: Star) -> DataFrame:
    years = s.txn(part=True).filter(F.year("tran_date").isin(1997, 1998)).groupBy("brand", F.year("tran_date").alias("y")).agg(money.total("amount").alias("total"))
    return ranking.merge_case(years.withColumnRenamed("brand", "name"))


# Versions and sets.
@query(f"""WITH {TXN}, r AS (SELECT donor_id, filer_id, tran_date, tran_id, min(amount) AS amount FROM txn WHERE tran_type = 'C' GROUP BY ALL)
SELECT donor_id, filer_id, tran_date, tran_id FROM r QUALIFY row_number() OVER (PARTITION BY donor_id, filer_id ORDER BY tran_date, tran_id) = 1""")
def first_gifts(s: Star) -> DataFrame:
    return dedup.first_gifts(s.txn().filter("tran_type = 'C'")).select("donor_id", "filer_id", "tran_date", "tran_id")


@query(f"""WITH {TXN} SELECT filer_id, max_by(part_name, tran_date::VARCHAR || lpad(tran_id::VARCHAR, 12, '0') || part_name) AS name FROM txn GROUP BY 1""")
def latest_name_per_id(s: Star) -> DataFrame:
    return ranking.latest_names(s.txn(part=True), "filer_id", "part_name", "tran_date", "tran_id")


_ORDER = "tran_date DESC, filed_date DESC, amount DESC, filer_id DESC, part_key DESC, quantity DESC"


@query(f"WITH {TXN} SELECT tran_id, amount, tran_date, filer_id, part_key FROM txn QUALIFY row_number() OVER (PARTITION BY tran_id ORDER BY {_ORDER}) = 1")
def dedup_keep_last(s: Star) -> DataFrame:
    return dedup.keep_last(s.txn(), "tran_id", ("tran_date", "filed_date", "amount", "filer_id", "part_key", "quantity")).select("tran_id", "amount", "tran_date", "filer_id", "part_key")


@query(f"""WITH {TXN}, v AS (SELECT filer_id, order_key, max(tran_date) AS filed, tran_id AS id FROM txn GROUP BY filer_id, order_key, tran_id)
SELECT filer_id, order_key AS chain, id AS tran_id FROM v QUALIFY row_number() OVER (PARTITION BY filer_id, order_key ORDER BY filed DESC, id DESC) = 1""")
def newest_in_chain(s: Star) -> DataFrame:
    rows = s.txn().groupBy("filer_id", "order_key", "tran_id").agg(F.max("tran_date").alias("filed_date")).withColumn("original_id", F.col("order_key"))
    return dedup.newest_amendments(rows)[0].select("filer_id", F.col("order_key").alias("chain"), "tran_id")


@query(f"""WITH {TXN}, v AS (SELECT order_key, tran_id, max(tran_date) AS filed, max(tran_type) = 'OD' AS gone FROM txn GROUP BY 1, 2),
w AS (SELECT *, last_value(gone) OVER (PARTITION BY order_key ORDER BY filed, tran_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dead FROM v)
SELECT order_key, tran_id FROM w WHERE NOT dead AND NOT gone""")
def deletion_chain(s: Star) -> DataFrame:
    rows = s.txn().groupBy("order_key", "tran_id").agg(F.max("tran_date").alias("filed_date"), F.when(F.max("tran_type") == "OD", "Deleted").otherwise("Original").alias("tran_status"))
    return dedup.apply_deletions(rows.withColumn("original_id", F.col("order_key"))).select("order_key", "tran_id")


@query(f"""WITH {TXN}, l AS (SELECT donor_id, filer_id, min(CASE order_status WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'rejected' ELSE 'open' END) AS status, max(filed_date) AS decided_at, max(quantity) AS score FROM txn GROUP BY 1, 2)
SELECT donor_id, filer_id AS link_id, status FROM l QUALIFY row_number() OVER (PARTITION BY donor_id ORDER BY status = 'rejected', status = 'confirmed' DESC, decided_at DESC, score DESC, filer_id) = 1""")
def best_link(s: Star) -> DataFrame:
    status = F.when(F.col("order_status") == "F", "confirmed").when(F.col("order_status") == "P", "rejected").otherwise("open")
    links = s.txn().groupBy("donor_id", F.col("filer_id").alias("link_id")).agg(F.min(status).alias("status"), F.max("filed_date").alias("decided_at"), F.max("quantity").alias("score"))
    return dedup.best_links(links, ["donor_id"]).select("donor_id", "link_id", "status")


@query(f"""WITH {TXN}, a AS (SELECT tran_id, max(amount) AS ours FROM txn WHERE tran_type <> 'E' GROUP BY 1), b AS (SELECT tran_id, max(amount) AS theirs FROM txn WHERE tran_type <> 'OD' GROUP BY 1)
SELECT tran_id, ours, theirs, CASE WHEN ours IS NULL THEN 'missing' WHEN theirs IS NULL THEN 'surplus' ELSE 'changed' END AS verdict FROM a FULL JOIN b USING (tran_id) WHERE ours IS DISTINCT FROM theirs""")
def id_set_diff(s: Star) -> DataFrame:
    a = s.txn().filter("tran_type <> 'E'").groupBy("tran_id").agg(F.max("amount").alias("amount"))
    b = s.txn().filter("tran_type <> 'OD'").groupBy("tran_id").agg(F.max("amount").alias("amount"))
    return dedup.difference(a, b)


@query(f"""WITH {TXN}, a AS (SELECT tran_id, max(amount) AS old_amount FROM txn WHERE year(tran_date) <= 1997 GROUP BY 1), b AS (SELECT tran_id, max(amount) AS new_amount FROM txn WHERE year(tran_date) >= 1997 GROUP BY 1)
SELECT tran_id, old_amount, new_amount FROM a JOIN b USING (tran_id) WHERE abs(old_amount - new_amount) > 0.005""")
def amount_drift(s: Star) -> DataFrame:
    return dedup.repriced(s.txn().filter(F.year("tran_date") <= 1997), s.txn().filter(F.year("tran_date") >= 1997))


@query(f"""WITH {TXN}, a AS (SELECT filer_id, donor_id FROM txn WHERE year(tran_date) = 1997), b AS (SELECT filer_id, donor_id FROM txn WHERE year(tran_date) = 1998)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def symmetric_except(s: Star) -> DataFrame:
    a, b = (s.txn().filter(F.year("tran_date") == y).select("filer_id", "donor_id") for y in (1997, 1998))
    return dedup.symmetric_difference(a, b)


@query(f"WITH {TXN} SELECT donor_id FROM txn WHERE tran_type = 'C' AND year(tran_date) = 1997 INTERSECT SELECT donor_id FROM txn WHERE tran_type = 'OD' AND year(tran_date) = 1998")
def set_intersect(s: Star) -> DataFrame:
    t = s.txn()
    return t.filter((F.col("tran_type") == "C") & (F.year("tran_date") == 1997)).select("donor_id").intersect(t.filter((F.col("tran_type") == "OD") & (F.year("tran_date") == 1998)).select("donor_id"))


@query(f"WITH {TXN} SELECT DISTINCT filer_id FROM txn WHERE donor_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)")
def semi_touched_filers(s: Star) -> DataFrame:
    donors = s.table("customer").filter("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("donor_id"))
    return graph.touched_filers(s.txn(), donors)


@query("SELECT c_custkey AS donor_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing_ids(s: Star) -> DataFrame:
    partial = s.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("donor_id"))
    return s.table("customer").select(F.col("c_custkey").alias("donor_id")).join(partial, "donor_id", "left_anti")


@query("""SELECT n.n_nationkey AS filer_id, n.n_name AS region_name, p.s_name AS name FROM nation n LEFT JOIN LATERAL
(SELECT s_name FROM supplier WHERE s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_name LIMIT 1) p ON true""")
def lateral_top1(s: Star) -> DataFrame:
    profiles = s.table("supplier").select(F.col("s_nationkey").alias("filer_id"), F.col("s_acctbal").alias("updated_at"), F.col("s_name").alias("slug"), F.col("s_name").alias("name"))
    best = ranking.top_profile(profiles).select("filer_id", "name")
    return s.table("nation").select(F.col("n_nationkey").alias("filer_id"), F.col("n_name").alias("region_name")).join(best, "filer_id", "left")


# Elections, posts and balances.
@query("""WITH r AS (SELECT year(o_orderdate) AS year, s_nationkey AS district, s_name AS candidate, CAST(sum(l_quantity) AS INT) AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY year, district ORDER BY votes DESC, candidate) AS k, sum(votes) OVER (PARTITION BY year, district) AS of, count(*) OVER (PARTITION BY year, district) AS n FROM r),
x AS (SELECT CAST(year AS INT) AS year, district, max(candidate) FILTER (WHERE k = 1) AS winner, max(candidate) FILTER (WHERE k = 2) AS runner_up, max(votes) FILTER (WHERE k = 1) AS a, max(votes) FILTER (WHERE k = 2) AS b, max(of) AS of, max(n) = 1 AS unopposed FROM w GROUP BY ALL)
SELECT year, district, winner, runner_up, CAST(of AS BIGINT) AS votes, unopposed, CAST(round(CAST((a - coalesce(b, 0)) * 100 AS DECIMAL(18,6)) / CAST(of AS DECIMAL(18,0)), 2) AS DECIMAL(18,2)) AS margin,
CASE WHEN year < 2012 THEN '2002-2010' WHEN year < 2022 THEN '2012-2020' ELSE '2022-' END AS era FROM x""")
def race_margins(s: Star) -> DataFrame:
    line, orders, supplier = s.table("lineitem"), s.table("orders"), s.table("supplier")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.year("o_orderdate").alias("year"), F.col("s_nationkey").alias("district"), F.col("s_name").alias("candidate")).agg(F.sum("l_quantity").cast("int").alias("votes"))
    rows = rows.withColumns({"office": F.lit("seat"), "election_type": F.lit("general"), "is_measure": F.lit(False)})
    return elections.race_margins(rows).select("year", "district", "winner", "runner_up", "votes", "unopposed", "margin", "era")


_TENURES = [("speaker", "Ann", "s1", None, None), ("speaker", "Bob", "s2", date(1997, 3, 10), None), ("speaker", "Cyd", "s3", date(1997, 3, 10), date(1997, 2, 1)), ("speaker", None, None, date(1998, 1, 1), None), ("speaker", "Dee", "s4", date(1998, 4, 20), None)]
_TENURES_SQL = "t(position, candidate, slug, start, counts_from) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"DATE '{x}'" if isinstance(x, date) else f"'{x}'" for x in r) + ")" for r in _TENURES) + ")"
_TENURE_TYPES = "position string, candidate string, slug string, start date, counts_from date"
_AS_OF = """h AS (SELECT d.day, t.*, coalesce(t.counts_from, t.start) AS since, rank() OVER (PARTITION BY d.day ORDER BY coalesce(t.counts_from, t.start) DESC NULLS LAST) AS k
FROM d JOIN t ON coalesce(t.counts_from, t.start) IS NULL OR coalesce(t.counts_from, t.start) <= d.day)"""


@query(f"""WITH {_TENURES_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate BETWEEN '1996-10-01' AND '1998-09-30'), {_AS_OF}
SELECT day, candidate FROM h WHERE k = 1 AND candidate IS NOT NULL""")
def asof_holder(s: Star) -> DataFrame:
    tenures = s.spark.createDataFrame(_TENURES, _TENURE_TYPES)
    days = s.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).filter(F.col("day").between(date(1996, 10, 1), date(1998, 9, 30))).distinct()
    return timeline.holders(tenures, days.withColumn("position", F.lit("speaker"))).select("day", "candidate")


@query(f"""WITH {TXN}, {_TENURES_SQL}, m AS (SELECT 's' || CAST(filer_id AS VARCHAR) AS slug, strftime(tran_date, '%Y-%m') AS month, sum(amount) AS amount FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2),
d AS (SELECT CAST(x AS DATE) + 14 AS day FROM generate_series(DATE '1996-12-01', DATE '1998-11-01', INTERVAL 1 MONTH) g(x)), {_AS_OF}
SELECT h.candidate, count(DISTINCT h.day) AS months, CAST(coalesce(sum(m.amount), 0) AS {MONEY}) AS amount FROM h LEFT JOIN m ON m.slug = h.slug AND m.month = strftime(h.day, '%Y-%m')
WHERE k = 1 AND candidate IS NOT NULL GROUP BY 1""")
def asof_monthly_credit(s: Star) -> DataFrame:
    tenures = s.spark.createDataFrame(_TENURES, _TENURE_TYPES)
    months = s.spark.range(1).select(F.explode(dates.months_between(F.lit("1996-12-01").cast("date"), F.lit("1998-11-01").cast("date"))).alias("month"), F.lit("speaker").alias("position"))
    amounts = timeline.monthly(s.txn(), "filer_id").withColumn("slug", F.concat(F.lit("s"), F.col("filer_id").cast("string")))
    return timeline.credited(tenures, months, amounts).select("candidate", "months", "amount")


@query(f"""WITH {TXN}, d AS (SELECT tran_date, sum(amount) AS total FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1),
a AS (SELECT tran_date AS day, sum(total) OVER (ORDER BY tran_date) AS cumulative FROM d WHERE tran_date BETWEEN DATE '1996-12-01' AND DATE '1998-11-30'),
b AS (SELECT tran_date + INTERVAL 2 YEAR AS day, sum(total) OVER (ORDER BY tran_date) AS past FROM d WHERE tran_date BETWEEN DATE '1994-12-01' AND DATE '1996-11-30')
SELECT a.day, CAST(a.cumulative AS {MONEY}) AS cumulative, CAST(coalesce(max(b.past), 0) AS {MONEY}) AS past FROM a LEFT JOIN b ON b.day <= a.day GROUP BY 1, 2""")
def calendar_aligned_cumulative(s: Star) -> DataFrame:
    from ..schema import is_cash_gift

    daily = s.txn().filter(is_cash_gift()).groupBy("tran_date").agg(money.total("amount").alias("total"))
    return timeline.aligned_cumulative(daily, 1998)


_STATEMENTS = f"""st AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, CAST(sum(amount) FILTER (WHERE tran_type = 'C') AS {MONEY}) AS opening,
CAST(sum(amount) FILTER (WHERE tran_type = 'E') AS {MONEY}) AS ending FROM txn GROUP BY 1, 2)"""


def _statements(s: Star) -> DataFrame:
    t = F.col("tran_type")
    return s.txn().groupBy("filer_id", F.year("tran_date").alias("year")).agg(F.sum(F.when(t == "C", F.col("amount"))).cast(money.MONEY).alias("opening"), F.sum(F.when(t == "E", F.col("amount"))).cast(money.MONEY).alias("ending"))


@query(f"""WITH {TXN}, {_STATEMENTS}, n AS (SELECT *, lead(year) OVER w AS next_year, lead(opening) OVER w AS next_opening FROM st WINDOW w AS (PARTITION BY filer_id ORDER BY year))
SELECT filer_id, year, next_year, CAST(next_opening - ending AS {MONEY}) AS step FROM n WHERE abs(next_opening - ending) > 0.01""")
def chain_breaks(s: Star) -> DataFrame:
    return timeline.chain_breaks(_statements(s))


@query(f"""WITH {TXN}, {_STATEMENTS}, n AS (SELECT *, lag(year) OVER w AS y, lag(ending) OVER w AS e FROM st WINDOW w AS (PARTITION BY filer_id ORDER BY year))
SELECT filer_id, year, CAST(opening - e AS {MONEY}) AS step FROM n WHERE y = year - 1 AND abs(opening - e) > 0.005""")
def restatements(s: Star) -> DataFrame:
    return timeline.restatements(_statements(s))


@query(f"""WITH {TXN}, a AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, count(*) FILTER (WHERE donor_id LIKE '%7') > 5 AS active FROM txn GROUP BY 1, 2)
SELECT filer_id, year, last_active FROM (SELECT *, max(year) FILTER (WHERE active) OVER (PARTITION BY filer_id) AS last_active FROM a) WHERE year > last_active""")
def trailing_blank(s: Star) -> DataFrame:
    years = s.txn().groupBy("filer_id", F.year("tran_date").alias("year")).agg((F.count(F.when(F.col("donor_id").like("%7"), 1)) > 5).alias("active"))
    return timeline.trailing_blank(years).select("filer_id", "year", "last_active")


@query(f"""WITH {TXN}, w AS (SELECT filer_id, strftime(tran_date, '%Y-%m') AS month, count(*) AS weight FROM txn WHERE year(tran_date) = 1997 GROUP BY 1, 2),
a AS (SELECT filer_id, CASE WHEN filer_id % 2 = 0 THEN -1 ELSE 1 END * (filer_id * 7919 + 13) AS cents FROM (SELECT DISTINCT filer_id FROM w)),
r AS (SELECT *, sum(weight) OVER (PARTITION BY filer_id) AS whole, abs(cents) AS size FROM w JOIN a USING (filer_id)),
f AS (SELECT *, size * weight // whole AS base, (size * weight) % whole AS remainder FROM r),
k AS (SELECT *, size - sum(base) OVER (PARTITION BY filer_id) AS rest, row_number() OVER (PARTITION BY filer_id ORDER BY remainder DESC, month) AS place FROM f)
SELECT filer_id, month, CAST(sign(cents) * (base + CASE WHEN place <= rest THEN 1 ELSE 0 END) AS BIGINT) AS cents FROM k""")
def hamilton_apportion(s: Star) -> DataFrame:
    weights = s.txn().filter(F.year("tran_date") == 1997).groupBy("filer_id", dates.month("tran_date").alias("month")).agg(F.count(F.lit(1)).alias("weight"))
    sign = F.when(F.col("filer_id") % 2 == 0, -1).otherwise(1)
    annual = weights.select("filer_id").distinct().withColumn("cents", (sign * (F.col("filer_id") * 7919 + 13)).cast("long"))
    return timeline.apportion(annual, weights, ["filer_id"])


@query(f"""WITH RECURSIVE {TXN}, d AS (SELECT filer_id, tran_date AS day, count(*) AS n FROM txn GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY filer_id ORDER BY day) AS i FROM d),
r(filer_id, i, day, n, bin, size) AS (
  SELECT filer_id, i, day, n, 0, n FROM o WHERE i = 1
  UNION ALL SELECT o.filer_id, o.i, o.day, o.n, CASE WHEN r.size + o.n > 50 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.size + o.n > 50 THEN o.n ELSE r.size + o.n END
  FROM r JOIN o ON o.filer_id = r.filer_id AND o.i = r.i + 1)
SELECT filer_id, CAST(bin AS INT) AS bin, min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def contiguous_bins(s: Star) -> DataFrame:
    days = s.txn().groupBy("filer_id", F.col("tran_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.tiles(days, "filer_id", 50)


_OURS = f"""o AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, coalesce(sum(amount) FILTER (WHERE tran_type = 'C'), 0) AS c,
coalesce(sum(amount) FILTER (WHERE tran_type = 'E' OR sub_type = 'In-Kind Contribution'), 0) AS e, coalesce(sum(amount) FILTER (WHERE tran_type = 'OD'), 0) AS d FROM txn GROUP BY 1, 2)"""


@query(f"""WITH {TXN}, {_OURS}, x AS (SELECT filer_id, year, CAST(CASE WHEN filer_id % 3 = 0 THEN -filer_id ELSE 0 END AS {MONEY}) AS contributions_delta, CAST(0 AS {MONEY}) AS expenditures_delta FROM o WHERE year <> 1996),
u AS (SELECT filer_id, year, CAST(c AS {MONEY}) AS contributions_delta, CAST(e AS {MONEY}) AS expenditures_delta FROM o WHERE year = 1996)
SELECT *, CASE WHEN contributions_delta <> 0 THEN 'flagged' ELSE 'agrees' END AS state, CASE WHEN abs(contributions_delta) > 1000 THEN 'HIGH' WHEN abs(contributions_delta) > 10 THEN 'MEDIUM' WHEN contributions_delta <> 0 THEN 'LOW' END AS severity FROM x
UNION ALL SELECT *, 'unchecked', NULL FROM u""")
def yearly_discrepancies(s: Star) -> DataFrame:
    ours = reconcile.ours_by_year(s.txn())
    theirs = ours.filter("year <> 1996").withColumn("contributions", (F.col("contributions") + F.when(F.col("filer_id") % 3 == 0, F.col("filer_id")).otherwise(0)).cast(money.MONEY))
    return reconcile.yearly_discrepancies(ours, theirs).select("filer_id", "year", "contributions_delta", "expenditures_delta", "state", "severity")


@query(f"""WITH {TXN}, y AS (SELECT s_nationkey AS scope, filer_id, year(tran_date) AS year, sum(amount) FILTER (WHERE tran_type = 'C') AS c, CASE WHEN filer_id % 7 = 0 THEN NULL ELSE sum(amount) END AS l, min(filed_date) AS f FROM txn WHERE filer_id % 5 <> 0 OR year(tran_date) <> 1998 GROUP BY 1, 2, 3),
z AS (SELECT s_nationkey AS scope, count(*) AS size FROM supplier GROUP BY 1)
SELECT y.scope, CAST(y.year AS INT) AS year, CAST(sum(coalesce(c, 0)) AS {MONEY}) AS contributions, CAST(CASE WHEN count(l) = count(*) THEN sum(l) END AS {MONEY}) AS loans_received FROM y JOIN z USING (scope)
GROUP BY 1, 2, size HAVING count(DISTINCT filer_id) = size""")
def combined_statements(s: Star) -> DataFrame:
    rows = s.txn().filter((F.col("filer_id") % 5 != 0) | (F.year("tran_date") != 1998))
    statements = rows.groupBy("filer_id", F.year("tran_date").alias("year")).agg(
        F.sum(F.when(F.col("tran_type") == "C", F.col("amount"))).cast(money.MONEY).alias("contributions"),
        F.when(F.col("filer_id") % 7 != 0, F.sum("amount")).cast(money.MONEY).alias("loans_received"),
        F.min("filed_date").alias("scrape_ts"),
    )
    scopes = s.table("supplier").select(F.col("s_nationkey").alias("scope"), F.col("s_suppkey").alias("filer_id"))
    return reconcile.combined_statements(statements, scopes).select("scope", "year", "contributions", "loans_received")


@query(f"""WITH {TXN} SELECT filer_id, {', '.join(f"CAST(coalesce(sum(CASE tran_type WHEN 'C' THEN amount ELSE -amount END) FILTER (WHERE filed_date <= DATE '{c}'), 0) AS {MONEY}) AS by_{c.replace('-', '_')}" for c in ('1996-12-31', '1997-06-30'))} FROM txn GROUP BY 1""")
def filed_by_cutoffs(s: Star) -> DataFrame:
    out = reconcile.filed_by(s.txn(), ["1996-12-31", "1997-06-30"])
    return out.toDF(*[c.replace("-", "_") for c in out.columns])


@query(f"""WITH {TXN}, m AS (SELECT filer_id, sum(amount) FILTER (WHERE sub_type = 'Cash Contribution') AS a, sum(amount) FILTER (WHERE tran_type = 'E') AS b FROM txn GROUP BY 1),
d AS (SELECT filer_id, CAST(a + CASE WHEN filer_id % 4 = 0 THEN filer_id ELSE 0 END AS {MONEY}) AS ours, CAST(a AS {MONEY}) AS expected FROM m)
SELECT filer_id, 'total_in' AS "check", ours, expected, CAST(ours - expected AS {MONEY}) AS delta, CASE WHEN ours - expected > 1000 THEN 'HIGH' WHEN ours - expected > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM d WHERE abs(ours - expected) > 0.02""")
def totals_audit(s: Star) -> DataFrame:
    months = timeline.monthly(s.txn(), "filer_id")
    details = timeline.totals_by(s.txn(), "filer_id").select("filer_id", (F.col("contributions") + F.when(F.col("filer_id") % 4 == 0, F.col("filer_id")).otherwise(0)).alias("total_in"), F.col("expenditures").alias("total_out"))
    return reconcile.audit(details, months)


# Scalar functions.
@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN '{V.POOLED}' ELSE trim(regexp_replace(replace('  ' || p_name || chr(160) || ' ' || p_brand || ' ', chr(160), ' '), '\\s+', ' ', 'g')) END AS label FROM part""")
def norm_label(s: Star) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 10 == 0, F.lit(f" {V.POOLED.upper()} ")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand", F.lit(" ")))
    return s.table("part").select(F.col("p_partkey").alias("id"), text.normalize_label(raw).alias("label"))


_NAMES = (
    # what is written, around a segment, and what it becomes
    ("{}, Inc. (1234)", "{} inc"), ("{}, Mary", "mary {}"), ("O'Brien  {}", "o brien {}"), ("  {}\t Smith ", "{} smith"), ("{}, A, B", "{} a b"), ("{}, 2nd", "{} 2nd"),
    ("Friends-of {}", "friends of {}"), ("{} (99)", "{}"), ("{} & Sons", "{} sons"), ("JOE {}", "joe {}"), ("", ""),
)
_ADDRESSES = (
    (" North Main Street, Apt 4", " n main st"), (" SE Hawthorne Boulevard", " se hawthorne blvd"), (" Oak Avenue  Suite 100", " oak ave"), (" Pine Rd. #7", " pine rd 7"), (" South  Elm Drive", " s elm dr"), (" Lake Court Unit B", " lake ct"),
)


def _case(pairs: list[tuple[str, str]], key: str, shown: str) -> str:
    """SQL that picks by key; ``{}`` stands for the column ``shown``."""
    text = lambda x: "'" + x.replace("'", "''").replace("{}", f"' || {shown} || '") + "'"
    return f"CASE {key} % {len(pairs)} " + " ".join(f"WHEN {k} THEN {text(x)}" for k, x in enumerate(p for p in pairs)) + " END"


def _choice(texts: list[str], key: str, shown: str) -> Column:
    out = F.lit(None).cast("string")
    for k, x in enumerate(texts):
        a, _, b = x.partition("{}")
        out = F.when(F.col(key) % len(texts) == k, F.concat(F.lit(a), F.col(shown) if "{}" in x else F.lit(""), F.lit(b))).otherwise(out)
    return out


@query(f"SELECT c_custkey AS id, {_case([n for _, n in _NAMES], 'c_custkey', 'lower(c_mktsegment)')} AS name FROM customer")
def norm_name(s: Star) -> DataFrame:
    return s.table("customer").select(F.col("c_custkey").alias("id"), text.norm_name(_choice([n for n, _ in _NAMES], "c_custkey", "c_mktsegment")).alias("name"))


@query(f"SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) || {_case([n for _, n in _ADDRESSES], 'c_custkey', 'c_custkey')} || '|' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS addr FROM customer")
def norm_addr(s: Star) -> DataFrame:
    raw = F.concat(F.col("c_custkey").cast("string"), _choice([n for n, _ in _ADDRESSES], "c_custkey", "c_custkey"))
    z = F.concat(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), F.lit("-1234"))
    return s.table("customer").select(F.col("c_custkey").alias("id"), text.norm_addr(raw, z).alias("addr"))


@query("""WITH w AS (SELECT regexp_replace(upper(regexp_extract(p_name, '[^ ]*$')), '[^A-Z]', '', 'g') AS w FROM part),
x AS (SELECT w, replace(replace(w, 'H', ''), 'W', '') AS bare FROM w),
c AS (SELECT w, left(w, 1) AS first, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(left(w, 1) || replace(replace(substr(w, 2), 'H', ''), 'W', ''),
  'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS digits FROM x)
SELECT CASE WHEN w = '' THEN '' ELSE lower(first || left(replace(substr(digits, 2), '0', '') || '000', 3)) END AS block, count(*) AS n FROM c GROUP BY 1""")
def soundex_block(s: Star) -> DataFrame:
    return s.table("part").select(text.soundex(F.element_at(F.split("p_name", " "), -1)).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_name AS name, left(trim(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', '_', 'g'), '_'), 60) AS slug FROM part")
def slug(s: Star) -> DataFrame:
    return s.table("part").select(F.col("p_name").alias("name"), text.slug(F.concat("p_name", F.lit("-"), "p_brand")).alias("slug")).distinct()


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_acctbal AS {MONEY}) END AS amount FROM customer""")
def money_parse(s: Star) -> DataFrame:
    value = F.col("c_acctbal").cast("decimal(18,2)")
    shown = F.format_number(F.abs(value), 2)
    raw = F.when(F.col("c_custkey") % 11 == 0, "n/a").when(value < 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown))
    return s.table("customer").select(F.col("c_custkey").alias("id"), text.money(raw).alias("amount"))


@query("""SELECT CAST(y AS INT) AS year, CASE WHEN y < 2012 THEN '2002-2010' WHEN y < 2022 THEN '2012-2020' ELSE '2022-' END AS era,
CAST((SELECT min(d) FROM generate_series(make_date(y, 5, 15), make_date(y, 5, 21), INTERVAL 1 DAY) g(d) WHERE dayofweek(d) = 2) AS DATE) AS primary_date FROM range(2002, 2030) t(y)""")
def district_era(s: Star) -> DataFrame:
    years = s.spark.range(2002, 2030).select(F.col("id").cast("int").alias("year"))
    return years.select("year", dates.district_era("year").alias("era"), dates.primary_date("year").alias("primary_date"))


@query(f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST({_CYCLE.replace('tran_date', 'o_orderdate')} AS INT) AS cycle, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def cycle_of_date(s: Star) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return s.table("orders").select(d.alias("d")).distinct().select("d", dates.cycle("d").alias("cycle"), dates.month("d").alias("month"))


@query("""WITH c(y, v) AS (VALUES (2006, 201.6), (2008, 215.303), (2010, 218.056), (2024, 313.689))
SELECT o_orderkey AS id, round(CASE WHEN v IS NULL THEN o_totalprice ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * 313.689::DOUBLE / v::DOUBLE END, 4) AS real_amount FROM orders LEFT JOIN c ON y = year(o_orderdate) + 11""")
def inflation_adjust(s: Star) -> DataFrame:
    shifted = F.year("o_orderdate") + 11
    year = F.when(shifted.isin(2006, 2008, 2010, 2024), shifted).otherwise(F.lit(0))
    return s.table("orders").select(F.col("o_orderkey").alias("id"), F.round(money.deflate(F.col("o_totalprice").cast("decimal(18,2)"), year), 4).alias("real_amount"))


@query("SELECT c_custkey AS id, 'd' || left(sha1(lower(c_name) || '|'), 12) AS entity_id FROM customer")
def entity_hash(s: Star) -> DataFrame:
    return s.table("customer").select(F.col("c_custkey").alias("id"), text.entity_id(text.alias_key(F.lower("c_name"), F.lit(""))).alias("entity_id"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props_extract(s: Star) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return s.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).cast("long").alias("k"))


@query(f"""WITH {TXN}, p AS (SELECT s_nationkey AS scope, list(s_suppkey) AS ids FROM supplier GROUP BY 1)
SELECT scope, CAST(sum(amount) AS {MONEY}) AS total FROM p JOIN txn ON list_contains(p.ids, filer_id) GROUP BY 1""")
def array_contains_scope(s: Star) -> DataFrame:
    scopes = s.table("supplier").groupBy(F.col("s_nationkey").alias("scope")).agg(F.collect_set("s_suppkey").alias("ids"))
    members = scopes.select("scope", F.explode(F.when(F.size("ids") > 0, F.col("ids"))).alias("filer_id"))
    return members.join(s.txn(), "filer_id").groupBy("scope").agg(money.total("amount").alias("total"))


@query(f"""WITH {TXN}, e AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, sha256('v1' || length(CAST(tran_id AS VARCHAR)) || ':' || tran_id || length(CAST(amount AS VARCHAR)) || ':' || amount) AS h FROM txn)
SELECT filer_id, year, {_DIGEST} AS digest FROM e GROUP BY 1, 2""")
def scope_digest(s: Star) -> DataFrame:
    rows = s.txn().withColumn("e", text.row_digest("tran_id", "amount"))
    return rows.groupBy("filer_id", F.year("tran_date").alias("year")).agg(text.scope_digest("e").alias("digest"))


# Identity.
#: Every customer and the next one, where they live in different nations: chains of many lengths.
_EDGES = "e AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 WHERE x.c_nationkey <> y.c_nationkey)"


@query(f"""WITH RECURSIVE {_EDGES}, g(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY 1""")
def identity_components(s: Star) -> DataFrame:
    return graph.components(_edges(s))


def _edges(s: Star) -> DataFrame:
    one = s.table("customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), F.col("c_nationkey").alias("n"))
    other = s.table("customer").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("m"))
    return one.join(other, "b").filter("n <> m").select("a", "b")


@query(f"""WITH RECURSIVE {TXN}, {_EDGES}, g(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node),
i AS (SELECT CAST(node AS VARCHAR) AS donor_id, CAST(min(root) AS VARCHAR) AS entity_id FROM r GROUP BY 1)
SELECT CASE WHEN pooled THEN donor_key ELSE coalesce(i.entity_id, t.donor_id) END AS donor_key, CAST(sum(CASE tran_type WHEN 'C' THEN amount ELSE -amount END) AS {MONEY}) AS total
FROM txn t LEFT JOIN i USING (donor_id) WHERE sub_type = 'Cash Contribution' OR tran_type = 'OD' GROUP BY 1""")
def identity_rekeyed_totals(s: Star) -> DataFrame:
    found = graph.components(_edges(s)).select(F.col("node").cast("string").alias("donor_id"), F.col("root").cast("string").alias("entity_id"))
    return ranking.netted(s.txn(donor=True), found).groupBy("donor_key").agg(money.total("total").alias("total"))


@query("""WITH n AS (SELECT lower(regexp_replace(trim(c_mktsegment || ' ' || c_nationkey || ' ' || CAST(floor(c_acctbal / 1000) AS INT)), '\\s+', ' ', 'g')) AS label, c_custkey % 40 AS entity FROM customer)
SELECT label, CAST(min(entity) AS VARCHAR) AS entity_id FROM n GROUP BY 1 HAVING count(DISTINCT entity) = 1""")
def label_unambiguous(s: Star) -> DataFrame:
    words = F.concat_ws("  ", "c_mktsegment", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 1000).cast("int").cast("string"))
    names = s.table("customer").select(F.col("c_custkey").alias("donor_id"), words.alias("name"))
    identity = s.table("customer").select(F.col("c_custkey").alias("donor_id"), (F.col("c_custkey") % 40).alias("entity_id"))
    return graph.unambiguous_labels(names, identity).select("label", F.col("entity_id").cast("string").alias("entity_id"))


@query(f"""WITH {NETTED}, y AS (SELECT DISTINCT year(tran_date) AS yr FROM txn WHERE filed_date > (SELECT max(filed_date) FROM txn) - INTERVAL 14 DAY)
SELECT CAST(year(tran_date) AS INT) AS yr, donor_key, CAST(sum(amount) AS {MONEY}) AS total, CAST(sum(gift) AS BIGINT) AS gifts FROM net WHERE year(tran_date) IN (SELECT yr FROM y) GROUP BY 1, 2""")
def dirty_year_rebuild(s: Star) -> DataFrame:
    from ..sources.sinks import dirty_years

    txn = s.txn(donor=True)
    last = s.table("orders").agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]
    new = txn.filter(F.col("filed_date") > F.date_sub(F.lit(last), 14))  # what a rolling fortnight reads again
    dirty = [r[0] for r in dirty_years(txn, new).collect()]  # years
    return ranking.year_totals(ranking.year_sums(ranking.netted(txn.filter(F.year("tran_date").isin(dirty)))))


@query()
def fuzzy_pairs(s: Star) -> DataFrame:
    return resolve.similar_pairs(_people(s)).select("alias_a", "alias_b", F.round("score", 6).alias("score"))


@query()
def resolver_clusters(s: Star) -> DataFrame:
    return resolve.clusters(_people(s))


def _people(s: Star) -> DataFrame:
    names = s.table("part").select("p_name", "p_brand", "p_type", (F.col("p_partkey") % 50).alias("z"))
    tuples = names.select(
        F.col("p_name").alias("raw_name"), F.col("p_brand").alias("addr"), F.lit("").alias("city"), F.lit("").alias("state"), F.lpad(F.col("z").cast("string"), 5, "0").alias("zip"),
        F.col("p_type").alias("employer"), F.lit("").alias("occupation"), F.lit("").alias("cid"), F.lit("Individual").alias("book_type"),
    )
    return resolve.keyed(resolve.contributor_tuples(tuples))


@query(f"""WITH {TXN}, l AS (SELECT DISTINCT donor_id, CAST(filer_id % 7 AS VARCHAR) AS lobbyist_id, max(CASE WHEN filer_id % 3 = 0 THEN 'rejected' WHEN filer_id % 3 = 1 THEN 'confirmed' ELSE 'open' END) AS status, max(CAST(quantity AS DOUBLE)) AS score FROM txn WHERE filer_id <= 20 GROUP BY 1, 2),
c AS (SELECT donor_id, 'k' || CAST(filer_id % 5 AS VARCHAR) AS client_key, min(book_type) AS client_name, CASE WHEN min(filer_id) % 4 = 0 THEN 'rejected' WHEN min(filer_id) % 4 = 1 THEN 'confirmed' ELSE 'open' END AS status, max(CAST(quantity AS DOUBLE)) AS score FROM txn WHERE filer_id > 20 GROUP BY 1, 2),
k(client_key, lobbyist_id, is_lead, active) AS (VALUES ('k0', '1', true, true), ('k0', '2', false, true), ('k1', '3', false, true), ('k1', '4', false, true), ('k2', '5', true, false), ('k2', '6', false, true), ('k3', '0', false, false)),
u AS (SELECT client_key, lobbyist_id FROM k WHERE active AND (is_lead OR NOT EXISTS (SELECT 1 FROM k j WHERE j.client_key = k.client_key AND j.active AND j.is_lead))),
p AS (SELECT donor_id, lobbyist_id, status = 'confirmed' AS confirmed, score FROM l WHERE status <> 'rejected' UNION ALL SELECT donor_id, lobbyist_id, status = 'confirmed', score FROM c JOIN u USING (client_key) WHERE status <> 'rejected')
SELECT donor_id, lobbyist_id, bool_or(confirmed) AS confirmed, max(score) AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.donor_id = p.donor_id AND l.lobbyist_id = p.lobbyist_id AND l.status = 'rejected') GROUP BY 1, 2""")
def lobby_paths(s: Star) -> DataFrame:
    t, f = s.txn(donor=True), F.col("filer_id")
    status = F.when(f % 3 == 0, "rejected").when(f % 3 == 1, "confirmed").otherwise("open")
    links = t.filter(f <= 20).groupBy("donor_id", (f % 7).cast("string").alias("lobbyist_id")).agg(F.max(status).alias("status"), F.max("quantity").alias("score"))
    least = F.min("filer_id") % 4
    client = t.filter(f > 20).groupBy("donor_id", F.concat(F.lit("k"), (f % 5).cast("string")).alias("client_key")).agg(
        F.min("book_type").alias("client_name"), F.when(least == 0, "rejected").when(least == 1, "confirmed").otherwise("open").alias("status"), F.max("quantity").alias("score"), F.max("filed_date").alias("decided_at")
    )
    rows = [("k0", "1", True, True), ("k0", "2", False, True), ("k1", "3", False, True), ("k1", "4", False, True), ("k2", "5", True, False), ("k2", "6", False, True), ("k3", "0", False, False)]
    clients = s.spark.createDataFrame(rows, "client_key string, lobbyist_id string, is_lead boolean, active boolean")
    return lobby.paths(links, client, clients).drop("clients")


@query(f"""WITH {TXN} SELECT filer_id, CAST({_CYCLE} AS INT) AS cycle, CAST(sum(amount) AS {MONEY}) AS raised FROM txn WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2""")
def cycle_sums(s: Star) -> DataFrame:
    return timeline.cycle_sums(s.txn(), "filer_id")


@query(f"""WITH {TXN} SELECT n_regionkey AS party, book_type, CAST(year(tran_date) AS INT) AS year, CAST(sum(amount) AS {MONEY}) AS total, count(*) AS n
FROM txn JOIN nation ON n_nationkey = s_nationkey WHERE sub_type = 'Cash Contribution' GROUP BY 1, 2, 3""")
def party_by_type_year(s: Star) -> DataFrame:
    party = s.table("nation").select(F.col("n_nationkey").alias("filer_nation"), F.col("n_regionkey").alias("party"))
    rows = s.txn(donor=True, filer=True).join(party, "filer_nation").withColumn("year", F.year("tran_date"))
    return timeline.by_party_type(rows)


@query(f"""WITH {TXN}, c AS (SELECT {_CYCLE} AS cycle, s_nationkey, amount FROM txn WHERE sub_type = 'Cash Contribution'),
t AS (SELECT n_regionkey AS party, CAST(coalesce(sum(amount) FILTER (WHERE cycle = 1998), 0) AS {MONEY}) AS past, CAST(coalesce(sum(amount) FILTER (WHERE cycle = 2000), 0) AS {MONEY}) AS now FROM c JOIN nation ON n_nationkey = s_nationkey WHERE cycle IN (1998, 2000) GROUP BY 1)
SELECT *, round(CAST(past AS DOUBLE) / CAST(sum(past) OVER () AS DOUBLE), 6) AS past_share, round(CAST(now AS DOUBLE) / CAST(sum(now) OVER () AS DOUBLE), 6) AS now_share FROM t""")
def party_composition(s: Star) -> DataFrame:
    from ..schema import is_cash_gift

    party = s.table("nation").select(F.col("n_nationkey").alias("filer_nation"), F.col("n_regionkey").alias("party"))
    return timeline.composition(s.txn(filer=True).filter(is_cash_gift()).join(party, "filer_nation"), (1998, 2000), "party")


@query(f"""WITH {TXN}, w AS (SELECT * FROM txn WHERE tran_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
SELECT filer_id, count(*) AS held, CAST(sum(amount) AS {MONEY}) AS amount, {_DIGEST} AS digest, CAST(count(*) FILTER (WHERE tran_type = 'OD') AS BIGINT) AS superseded
FROM (SELECT *, sha256('v1' || list_aggregate(list_transform([CAST(tran_id AS VARCHAR), CAST(tran_date AS VARCHAR), CAST(amount AS VARCHAR), tran_type, sub_type], lambda x: length(x) || ':' || x), 'string_agg', '')) AS h FROM w) GROUP BY 1""")
def filer_snapshots(s: Star) -> DataFrame:
    rows = s.txn()
    gone = rows.filter("tran_type = 'OD' and year(tran_date) = 1997").select("filer_id", "tran_id")
    return reconcile.snapshots(rows, gone, "1997-01-01", "1997-12-31")


@query(f"""WITH {TXN}, r AS (SELECT CAST(year(tran_date) AS INT) AS y, s_nationkey, filer, amount FROM txn WHERE sub_type = 'Cash Contribution')
SELECT * FROM (SELECT *, CAST(sum(raised) OVER (PARTITION BY race) AS {MONEY}) AS race_total FROM (SELECT s_nationkey AS race, filer AS candidate, CAST(sum(amount) AS {MONEY}) AS raised FROM r GROUP BY 1, 2))
QUALIFY dense_rank() OVER (ORDER BY race_total DESC, race) <= 6 AND row_number() OVER (PARTITION BY race ORDER BY raised DESC, candidate) <= 4""")
def races_to_watch(s: Star) -> DataFrame:
    from ..schema import is_cash_gift

    money_of = s.txn(filer=True).filter(is_cash_gift()).groupBy(F.col("filer_nation").alias("race"), F.col("filer").alias("candidate")).agg(money.total("amount").alias("raised"))
    return elections.races_to_watch(money_of).select("race", "candidate", "raised", "race_total")


# Events.
_WIDTH = "CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS total"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {_WIDTH} FROM events GROUP BY 1, 2")
def events_tumbling(s: Star) -> DataFrame:
    out = windows.tumbling(windows.timed(s.table("events")), "1 hour", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(f"""WITH e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, value FROM events), x AS (SELECT b AS window_start, value FROM e UNION ALL SELECT b - INTERVAL 30 MINUTE, value FROM e)
SELECT window_start, count(*) AS n, {_WIDTH} FROM x GROUP BY 1""")
def events_sliding(s: Star) -> DataFrame:
    out = windows.sliding(windows.timed(s.table("events")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS window_start, count(*) AS n, {_WIDTH} FROM k GROUP BY user_id, session""")
def events_session(s: Star) -> DataFrame:
    out = windows.sessions(windows.timed(s.table("events")))
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")
