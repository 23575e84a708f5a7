"""Summaries, monthly series, balances, cycles, shares and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import cycle, cycle_month, effective_date, month
from ..functions.money import MONEY, close, growth_percent, total, total_if
from ..schema import is_adjustment, is_cash_gift, is_in_kind, is_statement_contribution, is_statement_expenditure, moves_cash, signed_amount
from .ranking import top_n

BEFORE = (W.unboundedPreceding, -1)
UP_TO = (W.unboundedPreceding, 0)


def _t(kind: str) -> Column:
    return F.col("tran_type") == kind


def measures() -> list[Column]:
    """The named totals of any group of transactions, one pass."""
    cash_expenditure = _t("E") & (F.col("sub_type") == "Cash Expenditure")
    return [
        total_if(is_cash_gift(), "amount").alias("contributions"),
        total_if(_t("C") & is_in_kind(), "amount").alias("inkind"),
        total_if(_t("E"), "amount").alias("expenditures"),
        total_if(cash_expenditure, "amount").alias("cash_expenditures"),
        total_if(_t("OR"), "amount").alias("other_receipts"),
        total_if(_t("OD"), "amount").alias("other_disbursements"),
        total_if(is_adjustment(), "amount").alias("balance_adjustments"),
        total_if(is_statement_contribution(), "amount").alias("statement_contributions"),
        total_if(is_statement_expenditure(), "amount").alias("statement_expenditures"),
        F.count(F.lit(1)).alias("n"),
    ]


def summary(txn: DataFrame) -> DataFrame:
    return txn.agg(*measures(), F.min("tran_date").alias("first_date"), F.max("tran_date").alias("last_date"))


def totals_by(txn: DataFrame, *keys: str | Column) -> DataFrame:
    return txn.groupBy(*keys).agg(*measures())


def effective(txn: DataFrame) -> DataFrame:
    """Rows with a filed date; their effective date, year, month, and whether they are undated."""
    rows = txn.filter("filed_date is not null").withColumn("date", effective_date("tran_date", "filed_date"))
    return rows.withColumns({"year": F.year("date"), "month": month("date"), "undated": F.col("tran_date").isNull()})


def monthly(txn: DataFrame, *by: str) -> DataFrame:
    """Totals by month of the effective date; the three series in one pass instead of full joins."""
    return totals_by(effective(txn), *by, "month")


def by_type(txn: DataFrame, type_col: str = "book_type", outside: str = "outside", period: str | None = None) -> DataFrame:
    """Cash gifts by type, in state and out; rows of nothing left out; types in the order of both together."""
    keys = [type_col, outside] + ([period] if period else [])
    sums = txn.filter(is_cash_gift()).groupBy(*keys).agg(total("amount").alias("total"), F.count(F.lit(1)).alias("n")).filter("total <> 0")
    of = W.partitionBy(type_col, *([period] if period else []))
    sums = sums.withColumn("type_total", F.sum("total").over(of).cast(MONEY))
    return sums.withColumn("label", F.when(F.col(outside), F.concat(F.col(type_col), F.lit(" (out of state)"))).otherwise(F.col(type_col)))


def top_by_type(txn: DataFrame, donor: str, type_col: str = "book_type", outside: str = "outside", n: int = 5) -> DataFrame:
    sums = txn.filter(is_cash_gift()).groupBy(type_col, outside, donor).agg(total("amount").alias("total"))
    return top_n(sums, n, [F.desc("total"), F.asc(donor)], [type_col, outside])


def yearly_net(txn: DataFrame, *by: str) -> DataFrame:
    return txn.groupBy(*by, F.year("tran_date").alias("year")).agg(total(signed_amount()).alias("net"))


def cash_net(txn: DataFrame, *by: str) -> DataFrame:
    """Net of what moves cash: undated rows don't."""
    return txn.filter(moves_cash() & F.col("tran_date").isNotNull()).groupBy(*by).agg(total(signed_amount()).alias("net"))


def running_balance(nets: DataFrame, by: str = "filer_id", year: str = "year", opening: Column | None = None) -> DataFrame:
    """Opening and ending balance of each year from an anchor."""
    start = F.lit(0) if opening is None else opening
    w = W.partitionBy(by).orderBy(year)
    out = nets.withColumn("opening", (start + F.coalesce(F.sum("net").over(w.rowsBetween(*BEFORE)), F.lit(0))).cast(MONEY))
    return out.withColumn("ending", (F.col("opening") + F.col("net")).cast(MONEY))


def cumulative_cycle(txn: DataFrame, value: str = "amount", date: str = "tran_date") -> DataFrame:
    """Running total by month of each cycle; a month without rows counts nothing; up to the cycle's latest month."""
    rows = txn.withColumns({"cycle": cycle(date), "m": cycle_month(date)}).groupBy("cycle", "m").agg(total(value).alias("total"))
    spine = rows.groupBy("cycle").agg(F.max("m").alias("last")).select("cycle", F.explode(F.sequence(F.lit(1), "last")).alias("m"))
    out = spine.join(rows, ["cycle", "m"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast(MONEY)))
    return out.withColumn("cumulative", F.sum("total").over(W.partitionBy("cycle").orderBy("m").rowsBetween(*UP_TO)).cast(MONEY))


def elapsed_months(latest: str, year: int) -> int:
    """Months of a cycle up to the latest month, 1 at least."""
    months = [f"{y}-{m:02d}" for y, ms in ((year - 2, [12]), (year - 1, range(1, 13)), (year, range(1, 12))) for m in ms]
    return max(1, sum(m <= latest for m in months))


def cash_through(nets: DataFrame, opening: DataFrame, through: str, by: str = "filer_id") -> DataFrame:
    """Cash after a month: the balance of that year's January plus the months since."""
    year = int(through[:4])
    months = nets.filter(F.col("month").between(f"{year}-01", through)).groupBy(by).agg(total("net").alias("net"))
    start = opening.filter(F.col("year") == year).select(by, F.col("opening").alias("anchor"))
    return start.join(months, by, "left").select(by, (F.col("anchor") + F.coalesce("net", F.lit(0))).cast(MONEY).alias("cash"))


def chain_breaks(statements: DataFrame, by: str = "filer_id", within: str = "0.01") -> DataFrame:
    """Where a year's opening balance is not what the year before ended with."""
    w = W.partitionBy(by).orderBy("year")
    out = statements.withColumns({"next_year": F.lead("year").over(w), "next_opening": F.lead("opening").over(w)})
    out = out.withColumn("step", (F.col("next_opening") - F.col("ending")).cast(MONEY))
    return out.filter(~close("next_opening", "ending", within)).select(by, "year", "next_year", "step")


def restatements(statements: DataFrame, by: str = "filer_id") -> DataFrame:
    """Steps of more than half a cent between one year and the very next."""
    w = W.partitionBy(by).orderBy("year")
    out = statements.withColumns({"last_year": F.lag("year").over(w), "last_ending": F.lag("ending").over(w)})
    out = out.withColumn("step", (F.col("opening") - F.col("last_ending")).cast(MONEY))
    return out.filter((F.col("last_year") == F.col("year") - 1) & (F.abs("step") > F.lit("0.005").cast("decimal(18,4)"))).select(by, "year", "step")


def trailing_blank(years: DataFrame, by: str = "filer_id", active: str = "active") -> DataFrame:
    """The years at the end of each committee's run in which nothing happened."""
    last = F.max(F.when(F.col(active), F.col("year"))).over(W.partitionBy(by))
    return years.withColumn("last_active", last).filter(F.col("last_active").isNotNull() & (F.col("year") > F.col("last_active")))


def growth(months: DataFrame, by: str, windows: dict[str, tuple[list[str], list[str]]], value: str = "contributions") -> DataFrame:
    """Sums over each window's months and the months before it, and the growth in percent."""
    sums = []
    for name, (now, before) in windows.items():
        sums += [total_if(F.col("month").isin(*now), value).alias(f"{name}_now"), total_if(F.col("month").isin(*before), value).alias(f"{name}_before")]
    out = months.groupBy(by).agg(*sums)
    return out.withColumns({f"{n}_growth": growth_percent(f"{n}_now", f"{n}_before") for n in windows})


def top_growth(rows: DataFrame, by: str, name: str, least: float, n: int = 12) -> DataFrame:
    """The fastest growing with ``least`` in both windows."""
    both = rows.filter((F.col(f"{name}_now") >= least) & (F.col(f"{name}_before") >= least))
    return top_n(both, n, [F.desc(f"{name}_growth"), F.desc(f"{name}_now"), F.asc(by)])


def composition(txn: DataFrame, cycles: tuple[int, int], type_col: str = "book_type", value: str = "amount", date: str = "tran_date") -> DataFrame:
    """Shares of each type in two cycles, in the order of the past one's; a total of nothing counts as one."""
    past, now = cycles
    sums = txn.withColumn("cycle", cycle(date)).filter(F.col("cycle").isin(*cycles)).groupBy(type_col).agg(total_if(F.col("cycle") == past, value).alias("past"), total_if(F.col("cycle") == now, value).alias("now"))
    one = W.partitionBy(F.lit(0))
    whole = {c: F.sum(c).over(one).cast("double") for c in ("past", "now")}
    return sums.withColumns({f"{c}_share": F.round(F.col(c).cast("double") / F.when(w == 0, 1.0).otherwise(w), 6) for c, w in whole.items()})


def pivoted(rows: DataFrame, key: str, column: str, values: list, value: str = "total") -> DataFrame:
    """One column per value, null where there is nothing; ``values`` are listed, so there is no pass to find them."""
    sums = [total(F.when(F.col(column) == v, F.col(value))).alias(f"c_{v}") for v in values]
    return rows.filter(F.col(column).isin(*values)).groupBy(key).agg(*sums)


def shares(txn: DataFrame, by: str, type_col: str = "book_type") -> DataFrame:
    """Each type's percent of a committee's own total, 0 of nothing."""
    sums = txn.filter(is_cash_gift()).groupBy(by, type_col).agg(total("amount").alias("total"))
    whole = F.sum("total").over(W.partitionBy(by)).cast("double")
    return sums.withColumn("percent", F.round(F.when(whole == 0, 0.0).otherwise(F.col("total").cast("double") / whole * 100), 6))


def month_type_series(txn: DataFrame, type_col: str = "book_type", first: str = "2006-01") -> DataFrame:
    """Every month by every type, 0 where there is nothing; types without their out-of-state mark."""
    rows = txn.filter(is_cash_gift() & F.col("tran_date").isNotNull()).withColumns({"month": month("tran_date"), "type": F.regexp_replace(type_col, r" \(out of state\)$", "")})
    rows = rows.filter(F.col("month") >= first)
    sums = rows.groupBy("month", "type").agg(total("amount").alias("total"))
    types = F.array_sort(F.collect_set("type"))  # some types
    spine = sums.agg(F.min("month").alias("a"), F.max("month").alias("b"), types.alias("types"))
    span = F.transform(F.sequence(F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01"))), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    spine = spine.select(F.explode(span).alias("month"), "types").select("month", F.explode("types").alias("type"))
    return spine.join(sums, ["month", "type"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast(MONEY)))


def apportion(annual: DataFrame, weights: DataFrame, by: list[str], part: str = "month") -> DataFrame:
    """An annual amount (cents, any sign) dealt to parts by weight: floors, then a cent each by largest remainder, ties by part."""
    of = W.partitionBy(*by)
    rows = weights.join(annual, by).withColumns({"whole": F.sum("weight").over(of), "size": F.abs("cents")})
    raw = F.col("size") * F.col("weight")
    rows = rows.filter("whole > 0").withColumns({"floor": F.expr("cast((size * weight) div whole as bigint)"), "remainder": raw % F.col("whole")})
    rows = rows.withColumn("left", F.col("size") - F.sum("floor").over(of))
    rows = rows.withColumn("place", F.row_number().over(of.orderBy(F.desc("remainder"), F.asc(part))))
    cents = F.col("floor") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)
    return rows.select(*by, part, (F.signum("cents").cast("long") * cents).cast("long").alias("cents"))


def tiles(days: DataFrame, by: str, target: int) -> DataFrame:
    """Days in order cut into bins: a bin closes before the day that would take it past ``target`` rows; a day beyond it stands alone.

    One committee's days are folded in order; their number is bounded by the calendar.
    """
    sorted_days = F.array_sort(F.collect_list(F.struct("day", "n")))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["n"] + x["n"] > target) & (acc["n"] > 0)
        b = F.when(fresh, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(b.alias("bin"), F.when(fresh, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"), F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), b.alias("bin"), x["n"].alias("n")))).alias("out"))

    zero = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<day:date,bin:int,n:bigint>>").alias("out"))
    folded = days.withColumn("n", F.col("n").cast("long")).groupBy(by).agg(sorted_days.alias("days")).withColumn("out", F.aggregate("days", zero, step)["out"])
    return folded.select(by, F.explode("out").alias("d")).select(by, "d.day", "d.bin", "d.n").groupBy(by, "bin").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n"))


def holders(tenures: DataFrame, days: DataFrame) -> DataFrame:
    """As of each day, the holders of each post: all entries of the latest start on or before it; a vacancy has none.

    ``tenures``: position, candidate (null: vacant), start, counts_from; ``days``: position, day. A null start is since ever.
    """
    start = F.coalesce("counts_from", "start")
    rows = days.join(tenures.withColumn("since", start), "position").filter(F.col("since").isNull() | (F.col("since") <= F.col("day")))
    best = F.rank().over(W.partitionBy("position", "day").orderBy(F.desc_nulls_last("since")))
    return rows.withColumn("_r", best).filter("_r = 1 and candidate is not null").drop("_r")


def credited(tenures: DataFrame, months: DataFrame, amounts: DataFrame) -> DataFrame:
    """Each month's amount credited to who held the post on its 15th: position, candidate, since, months, amount."""
    days = months.withColumn("day", F.to_date(F.concat("month", F.lit("-15"))))
    rows = holders(tenures, days).join(amounts.select("slug", "month", F.col("contributions").alias("amount")), ["slug", "month"], "left")
    return rows.groupBy("position", "candidate", "since").agg(F.countDistinct("month").alias("months"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("amount"))


def aligned_cumulative(daily: DataFrame, year: int, years: int = 2) -> DataFrame:
    """Running totals of a cycle's days beside the last running total of the earlier cycle on or before the same calendar day."""

    def running(y: int) -> DataFrame:
        span = daily.filter(F.col("tran_date").between(F.lit(f"{y - 2}-12-01").cast("date"), F.lit(f"{y}-11-30").cast("date")))
        return span.withColumn("cumulative", F.sum("total").over(W.partitionBy(F.lit(0)).orderBy("tran_date").rowsBetween(*UP_TO)).cast(MONEY))

    now, past = running(year), running(year - years)
    spine = now.select(F.col("tran_date").alias("day"), F.col("cumulative"), F.lit(1).alias("side")).unionByName(
        past.select(F.add_months("tran_date", 12 * years).alias("day"), F.col("cumulative"), F.lit(0).alias("side"))
    )
    w = W.partitionBy(F.lit(0)).orderBy("day", "side").rowsBetween(*UP_TO)
    out = spine.withColumn("past", F.last(F.when(F.col("side") == 0, F.col("cumulative")), ignorenulls=True).over(w))
    return out.filter("side = 1").select("day", "cumulative", F.coalesce("past", F.lit(0)).cast(MONEY).alias("past"))


def stat_tiles(months: DataFrame, first: str, last: str) -> DataFrame:
    """The totals of a range of months, both included."""
    names = ("contributions", "inkind", "expenditures", "other_receipts", "other_disbursements", "balance_adjustments")
    return months.filter(F.col("month").between(first, last)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(MONEY).alias(c) for c in names])


def cycle_sums(txn: DataFrame, *by: str, value: str = "amount", date: str = "tran_date") -> DataFrame:
    """Cash gifts of each two-year cycle, December to November."""
    return txn.filter(is_cash_gift()).groupBy(*by, cycle(date).alias("cycle")).agg(total(value).alias("raised"))


def by_party_type(txn: DataFrame, party: str = "party", type_col: str = "book_type", period: str = "year", donors: str | None = None, n: int = 5) -> DataFrame:
    """Cash gifts by party, type and period; with ``donors``, each group's top donors instead, from all rows rather than from lists cut before."""
    gifts = txn.filter(is_cash_gift())
    if donors:
        return top_n(gifts.groupBy(party, type_col, period, donors).agg(total("amount").alias("total")), n, [F.desc("total"), F.asc(donors)], [party, type_col, period])
    return gifts.groupBy(party, type_col, period).agg(total("amount").alias("total"), F.count(F.lit(1)).alias("n"))
