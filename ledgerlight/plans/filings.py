"""Queries of statements, evidence, balances and identities; they join those of ``queries``."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as docs
from ..functions import money
from ..operators import dedup, elections, ranking, reconcile, resolve, timeline
from ..schema import is_statement_contribution, is_statement_expenditure, moves_cash
from .queries import QUERIES, SQL, query
from .star import MONEY, NETTED, TXN, Star

__all__ = ["QUERIES", "SQL"]

#: Net of a row as cash moves it, in SQL.
_NET = "CASE WHEN sub_type = 'Cash Contribution' THEN amount WHEN tran_type = 'E' OR tran_type = 'OD' THEN -amount ELSE 0 END"
_SIGNED = "CASE WHEN tran_type = 'C' THEN amount ELSE -amount END"
#: A yearly statement of each committee, as the driver's rows give one: each committee's first year opens with its number.
_STATEMENTS = f"""st AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, CAST(sum({_SIGNED}) AS {MONEY}) AS net, CAST(sum(amount) FILTER (WHERE tran_type = 'C') AS {MONEY}) AS contributions,
  CAST(filer_id + year(tran_date) AS {MONEY}) AS beginning_balance, max(filed_date) AS scrape_ts FROM txn GROUP BY 1, year(tran_date))"""


def _statements(s: Star) -> DataFrame:
    signed = F.when(F.col("tran_type") == "C", F.col("amount")).otherwise(-F.col("amount"))
    year = F.year("tran_date").alias("year")
    out = s.txn().groupBy("filer_id", year).agg(money.total(signed).alias("net"), F.sum(F.when(F.col("tran_type") == "C", F.col("amount"))).cast(money.MONEY).alias("contributions"), F.max("filed_date").alias("scrape_ts"))
    return out.withColumn("beginning_balance", (F.col("filer_id") + F.col("year")).cast(money.MONEY))


def _scopes(s: Star) -> DataFrame:
    return s.table("supplier").select(F.col("s_nationkey").alias("scope"), F.col("s_suppkey").alias("filer_id"))


# Statements.
@query(f"""WITH {TXN} SELECT filer_id, CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'C'), 0) AS {MONEY}) AS contributions,
CAST(coalesce(sum(amount) FILTER (WHERE tran_type = 'E'), 0) AS {MONEY}) AS expenditures FROM txn GROUP BY 1""")
def statement_types(s: Star) -> DataFrame:
    return s.txn().groupBy("filer_id").agg(money.total_if(is_statement_contribution(), "amount").alias("contributions"), money.total_if(is_statement_expenditure(), "amount").alias("expenditures"))


@query(f"""WITH {TXN} SELECT filer_id, CAST(sum({_NET}) AS {MONEY}) AS net FROM txn WHERE sub_type <> 'In-Kind Contribution' GROUP BY 1""")
def cash_nets(s: Star) -> DataFrame:
    return timeline.cash_net(s.txn(), "filer_id")


@query(f"""WITH {TXN} SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM txn WHERE sub_type <> 'In-Kind Contribution'""")
def cash_rows(s: Star) -> DataFrame:
    return s.txn().filter(moves_cash()).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))


@query(f"""WITH {TXN}, {_STATEMENTS} SELECT filer_id, year, net, beginning_balance FROM st QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY year DESC) = 1""")
def newest_statements(s: Star) -> DataFrame:
    return reconcile.newest_statements(_statements(s)).select("filer_id", "year", "net", "beginning_balance")


@query(f"""WITH {TXN}, {_STATEMENTS}, f AS (SELECT filer_id, min(year) AS first FROM st WHERE year > 1993 OR filer_id % 2 = 0 GROUP BY 1)
SELECT st.filer_id, st.year, st.net, CAST(st.filer_id + first AS {MONEY}) AS anchor FROM st JOIN f USING (filer_id) WHERE year >= first""")
def anchored_nets(s: Star) -> DataFrame:
    rows = _statements(s)
    return reconcile.anchored(rows.filter("year > 1993 or filer_id % 2 = 0"), rows.select("filer_id", "year", "net"))


@query(f"""WITH {TXN}, e AS (SELECT filer_id, CAST(min(year(tran_date)) AS INT) AS y FROM txn GROUP BY 1 HAVING count(*) > 500 OR filer_id % 2 = 0), m AS (SELECT s_nationkey AS scope, s_suppkey AS filer_id FROM supplier)
SELECT scope, min(y) AS earliest_year, CAST(sum(filer_id) AS {MONEY}) AS beginning_balance, bool_and(y <= 1992) AS reached_earliest FROM m LEFT JOIN e USING (filer_id) GROUP BY 1 HAVING count(*) = count(y)""")
def scope_opening_balances(s: Star) -> DataFrame:
    earliest = s.txn().groupBy("filer_id").agg(F.min(F.year("tran_date")).alias("earliest_year"), F.count(F.lit(1)).alias("n")).filter("n > 500 or filer_id % 2 = 0")
    earliest = earliest.select("filer_id", "earliest_year", F.col("filer_id").cast(money.MONEY).alias("beginning_balance"), (F.col("earliest_year") <= 1992).alias("reached_earliest"))
    return reconcile.opening_balances(earliest, _scopes(s))


@query(f"""WITH {TXN}, c AS (SELECT filer_id, max(filed_date) - INTERVAL 60 DAY AS day FROM txn GROUP BY 1)
SELECT filer_id, CAST(coalesce(sum({_SIGNED}) FILTER (WHERE filed_date < day), 0) AS {MONEY}) AS before, CAST(coalesce(sum({_SIGNED}) FILTER (WHERE filed_date = day), 0) AS {MONEY}) AS on_the_day FROM txn JOIN c USING (filer_id) GROUP BY 1""")
def nets_around_capture(s: Star) -> DataFrame:
    captures = s.txn().groupBy("filer_id").agg(F.date_sub(F.max("filed_date"), 60).alias("captured_on"))
    return reconcile.around_capture(s.txn(), captures)


@query(f"""WITH {TXN}, {_STATEMENTS}, b AS (SELECT filer_id, year, CAST(beginning_balance + net AS {MONEY}) AS ending FROM st),
x AS (SELECT filer_id, max(year) + 1 AS closing FROM st GROUP BY 1 HAVING filer_id % 2 = 0)
SELECT filer_id, CAST(closing AS INT) AS year, CAST(-arg_max(ending, b.year) AS {MONEY}) AS amount FROM b JOIN x USING (filer_id) WHERE b.year < closing GROUP BY 1, 2 HAVING arg_max(ending, b.year) <> 0""")
def closure_resets(s: Star) -> DataFrame:
    rows = _statements(s)
    balances = rows.select("filer_id", "year", (F.col("beginning_balance") + F.col("net")).cast(money.MONEY).alias("ending"))
    closed = rows.filter("filer_id % 2 = 0").groupBy("filer_id").agg((F.max("year") + 1).alias("year"))
    return reconcile.closure_rows(balances, closed)


@query(f"""WITH {TXN}, {_STATEMENTS} SELECT filer_id, make_date(year, 1, 1) AS tran_date, CAST(abs(net) AS {MONEY}) AS amount, 'O' AS tran_type, CAST(sign(net) AS INT) AS sign FROM st WHERE net <> 0""")
def certificate_rows(s: Star) -> DataFrame:
    out = reconcile.ghost_rows(_statements(s).filter("net <> 0").select("filer_id", "year", F.col("net").alias("step")))
    sign = next(c for c in out.columns if c not in ("filer_id", "tran_date", "amount", "tran_type", "sub_type"))
    return out.select("filer_id", "tran_date", "amount", "tran_type", F.col(sign).cast("int").alias("sign"))


@query(f"""WITH {TXN}, {_STATEMENTS} SELECT filer_id, year, CAST(CASE WHEN filer_id % 3 = 0 THEN 0 ELSE contributions - net END AS {MONEY}) AS correction FROM st""")
def loan_corrections(s: Star) -> DataFrame:
    rows = _statements(s)
    ours = rows.select("filer_id", "year", F.col("net").alias("our_loans"))
    return reconcile.non_exempt_corrections(ours, rows.filter("filer_id % 3 <> 0").select("filer_id", "year", F.col("contributions").alias("loans_received")))


# Evidence.
@query("""WITH c AS (SELECT s_suppkey AS filer_id, s_suppkey % 2 = 0 AS complete FROM supplier WHERE s_acctbal > 0),
d AS (SELECT s_suppkey AS filer_id, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS complete FROM supplier WHERE s_nationkey < 10)
SELECT filer_id, CASE WHEN d.filer_id IS NOT NULL THEN d.complete ELSE c.complete END AS complete FROM c FULL JOIN d USING (filer_id)""")
def completeness_map(s: Star) -> DataFrame:
    return _complete(s)


def _complete(s: Star) -> DataFrame:
    k = F.col("s_suppkey")
    counts = s.table("supplier").filter("s_acctbal > 0").select(k.alias("filer_id"), (k % 2 == 0).alias("complete"))
    diffs = s.table("supplier").filter("s_nationkey < 10").select(k.alias("filer_id"), F.when(k % 5 == 0, F.lit(None).cast("boolean")).otherwise(k % 5 == 1).alias("complete"))
    return reconcile.completeness(counts, diffs)


@query("""WITH r AS (SELECT s_nationkey AS scope, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN s_acctbal > 0 ELSE true END AS complete FROM supplier)
SELECT scope, CASE WHEN bool_or(NOT complete) THEN false WHEN count(complete) < count(*) THEN NULL ELSE true END AS complete FROM r GROUP BY 1""")
def scope_completeness(s: Star) -> DataFrame:
    k = F.col("s_suppkey") % 4
    value = F.when(k == 0, F.lit(None).cast("boolean")).when(k == 1, F.col("s_acctbal") > 0).otherwise(F.lit(True))
    return reconcile.all_complete(s.table("supplier").select(F.col("s_nationkey").alias("scope"), value.alias("complete")))


@query(f"""WITH {TXN}, m AS (SELECT s_nationkey AS scope, count(*) AS size FROM supplier GROUP BY 1)
SELECT scope, part_key AS tran_id FROM txn JOIN m ON scope = s_nationkey GROUP BY scope, part_key, size HAVING count(DISTINCT filer_id) = size""")
def certified_ids(s: Star) -> DataFrame:
    return reconcile.certified_absent(s.txn().select("filer_id", F.col("part_key").alias("tran_id")), _scopes(s))


@query(f"""WITH {TXN}, b AS (SELECT filer_id, CAST(sum({_SIGNED}) AS {MONEY}) AS ending, bool_or(s_nationkey >= 5) AS shown FROM txn GROUP BY 1)
SELECT CAST(coalesce(sum(ending) FILTER (WHERE shown), 0) AS {MONEY}) AS cash_on_hand, count(*) FILTER (WHERE NOT shown) AS excluded FROM b""")
def global_cash(s: Star) -> DataFrame:
    kinds = s.table("supplier").select(F.col("s_suppkey").alias("filer_id"), F.when(F.col("s_nationkey") < 5, "independent expenditure").otherwise("committee").alias("filer_type"))
    signed = F.when(F.col("tran_type") == "C", F.col("amount")).otherwise(-F.col("amount"))
    balances = s.txn().groupBy("filer_id").agg(money.total(signed).alias("ending"))
    return reconcile.cash_on_hand(balances.join(reconcile.publishes_balance(kinds), "filer_id"))


@query(f"""WITH {TXN}, n AS (SELECT filer_id, strftime(tran_date, '%Y-%m') AS month, sum({_SIGNED}) AS net FROM txn GROUP BY 1, 2)
SELECT s_suppkey AS filer_id, CAST(s_suppkey + coalesce(sum(net) FILTER (WHERE month BETWEEN '1997-01' AND '1997-07'), 0) AS {MONEY}) AS cash FROM supplier LEFT JOIN n ON s_suppkey = filer_id GROUP BY 1""")
def cash_through_month(s: Star) -> DataFrame:
    signed = F.when(F.col("tran_type") == "C", F.col("amount")).otherwise(-F.col("amount"))
    nets = s.txn().groupBy("filer_id", F.date_format("tran_date", "yyyy-MM").alias("month")).agg(money.total(signed).alias("net"))
    opening = s.table("supplier").select(F.col("s_suppkey").alias("filer_id"), F.lit(1997).alias("year"), F.col("s_suppkey").cast(money.MONEY).alias("opening"))
    return timeline.cash_through(nets, opening, "1997-07")


@query(f"""WITH {TXN}, c AS (SELECT filer_id, CAST(year(tran_date) AS INT) AS year, tran_type, order_key AS chain, CAST(sum(amount) AS {MONEY}) AS amount, max(filed_date) AS filed_date FROM txn GROUP BY 1, year(tran_date), 3, 4),
k AS (SELECT * FROM c WHERE filed_date <= make_date(year + 1, 3, 31)), s AS (SELECT filer_id, year, tran_type, count(*) AS chains, sum(amount) AS counted FROM k GROUP BY 1, 2, 3)
SELECT filer_id, year, tran_type, chains, CAST(CASE WHEN filer_id % 2 = 0 THEN counted END AS {MONEY}) AS counted FROM s""")
def early_amendments(s: Star) -> DataFrame:
    rows = s.txn().groupBy("filer_id", F.year("tran_date").alias("year"), "tran_type", F.col("order_key").alias("chain")).agg(money.total("amount").alias("amount"), F.max("filed_date").alias("filed_date"), F.max("tran_id").alias("tran_id"))
    counted = rows.filter(F.col("filed_date") <= F.make_date(F.col("year") + 1, F.lit(3), F.lit(31))).groupBy("filer_id", "year", "tran_type").agg(F.sum("amount").alias("reported"))
    reported = counted.withColumn("reported", (F.col("reported") + F.col("filer_id") % 2).cast(money.MONEY))
    return reconcile.counted_amendments(rows, reported).select("filer_id", "year", "tran_type", "chains", F.col("counted").cast(money.MONEY).alias("counted"))


# Identities.
@query(f"""WITH {TXN}, d AS (SELECT donor_id, sum(amount) FILTER (WHERE sub_type = 'Cash Contribution') AS given, count(*) FILTER (WHERE tran_type = 'C') AS gifts, min(tran_date) AS first_date, max(tran_date) AS last_date FROM txn GROUP BY 1)
SELECT CASE WHEN CAST(donor_id AS BIGINT) % 3 = 0 THEN donor_id ELSE CAST(CAST(donor_id AS BIGINT) // 10 AS VARCHAR) || 'e' END AS entity_id, CAST(coalesce(sum(given), 0) AS {MONEY}) AS total_given,
CAST(sum(gifts) AS BIGINT) AS gift_count, count(*) AS members, min(first_date) AS first_date, max(last_date) AS last_date FROM d GROUP BY 1""")
def entity_rollup(s: Star) -> DataFrame:
    rows = s.txn(donor=True)
    k = F.col("donor_id").cast("long")
    identity = rows.select("donor_id").distinct().filter(k % 3 != 0).withColumn("entity_id", F.concat(F.floor(k / 10).cast("string"), F.lit("e")))
    return ranking.identity_rollup(ranking.donor_rollup(rows, ()), identity)


@query(f"""WITH {TXN}, i AS (SELECT CAST(c_custkey AS VARCHAR) AS donor_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT donor_id, filer_id, tran_id, tran_date FROM txn JOIN i USING (donor_id) QUALIFY row_number() OVER (PARTITION BY donor_id, filer_id ORDER BY tran_date, tran_id) = 1""")
def first_gifts_of_ids(s: Star) -> DataFrame:
    ids = s.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("donor_id"))
    return dedup.first_gifts(s.txn(), ids).select("donor_id", "filer_id", "tran_id", "tran_date")


@query(f"""WITH {TXN}, t AS (SELECT label AS name, sum(amount) AS total FROM txn WHERE tran_type = 'C' GROUP BY 1), e AS (SELECT DISTINCT label, book_type FROM txn WHERE NOT pooled AND c_nationkey < 20)
SELECT coalesce(book_type, 'name:' || lower(name)) AS key, CAST(sum(total) AS {MONEY}) AS total FROM t LEFT JOIN e ON label = name GROUP BY 1""")
def rekeyed_names(s: Star) -> DataFrame:
    rows = s.txn(donor=True).withColumn("contributor_payee", F.when(F.col("donor_id").cast("long") % 97 == 0, F.lit("Miscellaneous Cash Contributions $100 and under")).otherwise(F.col("contributor_payee")))
    items = rows.filter("tran_type = 'C'").groupBy(F.col("contributor_payee").alias("name")).agg(money.total("amount").alias("total"))
    known = rows.filter((F.col("donor_id").cast("long") % 97 != 0) & (F.col("donor_nation") < 20)).select(F.col("contributor_payee").alias("label"), F.col("book_type").alias("entity_id")).distinct()
    return ranking.rekey(items, known).select("key", "total")


@query(f"""WITH {TXN} SELECT filer_id, arg_max(part_name, strftime(filed_date, '%Y-%m-%d') || lpad(CAST(tran_id AS VARCHAR), 12, '0')) AS name FROM txn GROUP BY 1""")
def latest_names(s: Star) -> DataFrame:
    return ranking.latest_names(s.txn(part=True), "filer_id", "part_name", "filed_date", "tran_id")


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Independent' WHEN 1 THEN 'Democrat' WHEN 2 THEN 'Republican' END AS party FROM supplier""")
def party_of_committees(s: Star) -> DataFrame:
    k = F.col("s_suppkey") % 4
    rows = s.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "Independent").when(k == 1, "  ").alias("said"), F.when(k == 1, "Senate DEMOCRATIC caucus").when(k == 2, "house Republicans").when(k == 0, "Democrat").alias("nature"))
    return rows.select("id", elections.party_attribution("said", "nature").alias("party"))


@query(f"""WITH {TXN}, x AS (SELECT tran_id, CASE WHEN filer_id % 4 = 0 THEN 'c' || filer_id ELSE CAST(donor_id AS VARCHAR) || 'e' END AS donor_id FROM txn WHERE c_nationkey < 20 OR filer_id % 4 = 0)
SELECT donor_id, count(*) AS n FROM x GROUP BY 1""")
def stamped_donors(s: Star) -> DataFrame:
    rows = s.txn(donor=True).select(F.col("donor_id").alias("raw_name"), F.when(F.col("donor_nation") % 2 == 0, "").alias("addr"), F.lit("9").alias("zip"), F.when(F.col("filer_id") % 4 == 0, F.col("filer_id").cast("string")).alias("cid"))
    aliases = s.table("customer").filter("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("raw_name"), F.lit("").alias("addr"), F.lit("9").alias("zip"), F.concat(F.col("c_custkey").cast("string"), F.lit("e")).alias("entity_id"))
    return resolve.stamp(rows, aliases).filter("donor_id is not null").groupBy("donor_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NETTED}, g AS (SELECT donor_key, year(tran_date) AS y, sum(amount) AS total FROM net GROUP BY 1, 2) SELECT CAST(y AS INT) AS yr, count(*) AS donors, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM g GROUP BY 1""")
def raw_year_sums(s: Star) -> DataFrame:
    sums = ranking.year_totals(ranking.year_sums(ranking.netted(s.txn(donor=True))))
    return sums.groupBy("yr").agg(F.count(F.lit(1)).alias("donors"), F.sum("total").cast("decimal(38,2)").alias("total"))


@query("""WITH m AS (SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1) SELECT state, n FROM m""")
def state_tally(s: Star) -> DataFrame:
    return reconcile.tally(s.table("orders").select(F.col("o_orderstatus").alias("state")))


# JSON documents.
@query("""SELECT event_id, json_exists(props, '$.k') AS has_k, coalesce(json_exists(props, '$.k') OR json_exists(props, '$.zzz'), false) AS any_key, json_type(props) = 'OBJECT' AS is_object FROM events""")
def json_keys(s: Star) -> DataFrame:
    return s.table("events").select("event_id", docs.has_key("props", "k").alias("has_k"), docs.has_any_key("props", "k", "zzz").alias("any_key"), (docs.kind("props") == "object").alias("is_object"))


@query("""WITH n AS (SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_name) || ']' AS nations,
'{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys, count(*) AS n FROM nation GROUP BY 1)
SELECT n_regionkey AS region, nations, keys, json_array_length(nations)::INT AS n, '{"region":' || n_regionkey || ',"nations":' || n || '}' AS doc FROM n""")
def json_reports(s: Star) -> DataFrame:
    one = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    out = s.table("nation").groupBy(F.col("n_regionkey").alias("region")).agg(docs.gathered(one, F.col("n_name")).alias("nations"), docs.gathered_object(F.col("n_name"), F.col("n_nationkey")).alias("keys"))
    out = out.withColumn("n", docs.array_length("nations"))
    return out.withColumn("doc", docs.build_object(region=F.col("region"), nations=F.col("n")))


@query("""SELECT n_regionkey AS region, n_name AS name FROM nation""")
def json_elements(s: Star) -> DataFrame:
    lists = s.table("nation").groupBy(F.col("n_regionkey").alias("region")).agg(docs.gathered(F.col("n_name"), F.col("n_nationkey")).alias("names"))
    return lists.select("region", F.explode(docs.elements("names")).alias("name"))
