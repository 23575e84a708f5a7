"""Donor, recipient and payee rankings, profiles and rollups.

Every ranking sums before it cuts, so partial sums are made before the shuffle, and breaks ties by a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import values as V
from ..functions.money import MONEY, total, total_if
from ..functions.text import bucket_label, display_label, donor_key, is_pooled, normalize_label, present
from ..schema import is_cash_gift, is_in_kind, is_refund, within


def top_n(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, ranked from 1. Spark prunes groups before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def netted(txn: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Cash gifts and refunds (negative) in one pass: filer_id, tran_date, donor_key, donor_id, label, total, gifts.

    Rows are not summed here: what follows sums them by its own key, in part before the shuffle. ``identity`` (donor_id, entity_id)
    names merged donors; then rows are summed by donor first, so that the join meets sums. The pooled label is one donor without an id.
    """
    gift = is_cash_gift()
    rows = txn.filter(gift | is_refund()).select(
        "filer_id",
        "tran_date",
        F.col("donor_id").cast("string").alias("donor_id"),
        "contributor_payee",
        F.when(gift, F.col("amount")).otherwise(-F.col("amount")).cast(MONEY).alias("total"),
        F.when(gift, 1).otherwise(0).cast("long").alias("gifts"),
    )
    if identity is not None:
        rows = rows.groupBy("filer_id", "tran_date", "donor_id", "contributor_payee").agg(total("total").alias("total"), F.sum("gifts").alias("gifts"))
        rows = rows.join(identity.select(F.col("donor_id").cast("string").alias("donor_id"), "entity_id"), "donor_id", "left").withColumn("donor_id", F.coalesce("entity_id", "donor_id")).drop("entity_id")
    rows = rows.withColumn("label", bucket_label(normalize_label("contributor_payee")))
    rows = rows.withColumn("donor_id", F.when(~is_pooled("label"), F.col("donor_id")))
    return rows.withColumn("donor_key", donor_key("donor_id", "label")).drop("contributor_payee")


def donor_rows(txn: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """``netted`` rows summed by committee, date and donor."""
    return netted(txn, identity).groupBy("filer_id", "tran_date", "donor_key", "donor_id", "label").agg(total("total").alias("total"), F.sum("gifts").alias("gifts"))


def scoped(rows: DataFrame, start: str | None = None, end: str | None = None, filers: list | None = None) -> DataFrame:
    test = within(start, end)
    rows = rows if test is None else rows.filter(test)
    return rows if filers is None else rows.filter(F.col("filer_id").isin(*filers) if filers else F.lit(False))


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals of each donor with a name, in two steps.

    The first sums by donor and spelling in a hash aggregate, in part before the shuffle; only its few rows meet the
    choice of a name, which needs a sorted aggregate.
    """
    first = rows.groupBy(*keys, "donor_key", "donor_id", "label").agg(total("total").alias("total"), F.sum("gifts").alias("gifts"))
    return first.groupBy(*keys, "donor_key").agg(F.max("donor_id").alias("donor_id"), display_label("label").alias("name"), total("total").alias("total"), F.sum("gifts").alias("gifts"))


def donor_leaderboard(rows: DataFrame, start: str | None = None, end: str | None = None, filers: list | None = None, limit: int = 1000) -> DataFrame:
    """Donors by netted total in a scope; none that net to nothing or less. ``filers`` None is all."""
    sums = summed(scoped(rows, start, end, filers))
    return top_n(sums.filter("total > 0"), limit, [F.desc("total"), F.asc("donor_key")])


def leaderboard_by_year(rows: DataFrame, limit: int = 1000, **scope) -> DataFrame:
    """The leaders' totals by year; dated years that net to more than nothing."""
    leaders = donor_leaderboard(rows, limit=limit, **scope).select("donor_key")
    years = scoped(rows, **scope).filter("tran_date is not null").groupBy("donor_key", F.year("tran_date").alias("year")).agg(total("total").alias("total"))
    return years.filter("total > 0").join(leaders, "donor_key")


def top_by_year(rows: DataFrame, limit: int = 1000, undated: bool = False) -> DataFrame:
    """Each year ranked on its own; undated rows are year 0 and left out unless asked for."""
    rows = rows if undated else rows.filter("tran_date is not null")
    years = summed(rows.withColumn("year", F.coalesce(F.year("tran_date"), F.lit(0))), "year").drop("donor_id", "gifts")
    return top_n(years.filter("total > 0"), limit, [F.desc("total"), F.asc("donor_key")], ["year"])


def ranked_sets(rows: DataFrame, limit: int = 1000, by: str = "filer_id") -> DataFrame:
    """All-time and per-year lists of each committee in one pass of grouping sets; ``year`` null is all time.

    Undated rows are in the all-time list only: grouping() tells them from it.
    """
    rows = rows.groupBy(by, "donor_key", "label", F.year("tran_date").alias("year")).agg(total("total").alias("total"))
    sets = rows.groupingSets([[F.col(by), F.col("donor_key")], [F.col(by), F.col("donor_key"), F.col("year")]], F.col(by), F.col("donor_key"), F.col("year"))
    sums = sets.agg(F.grouping("year").cast("int").alias("all_years"), total("total").alias("total"), display_label("label").alias("name"))
    sums = sums.filter("(all_years = 1 or year is not null) and total > 0")
    return top_n(sums, limit, [F.desc_nulls_last("total"), F.asc("donor_key")], [by, "all_years", "year"])


def latest_names(txn: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """Each key's trimmed name from its latest row that has one."""
    named = txn.filter(present(name).isNotNull())
    return named.groupBy(key).agg(F.max_by(F.trim(name), F.struct(*order, name)).alias("name"))


def top_profile(profiles: DataFrame, key: str = "filer_id") -> DataFrame:
    """One profile per committee: the last updated, nulls last, then by slug."""
    order = W.partitionBy(key).orderBy(F.desc_nulls_last("updated_at"), "slug")
    return profiles.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def recipient_leaderboard(txn: DataFrame, profiles: DataFrame | None = None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """Committees by cash gifts between two dates; named by profile, else by their latest row."""
    rows = scoped(txn.filter(is_cash_gift() & F.col("filer_id").isNotNull()), start, end)
    spelt = rows.groupBy("filer_id", "filer").agg(total("amount").alias("total"), F.count(F.lit(1)).alias("gifts"), F.max("tran_date").alias("latest"))
    sums = spelt.groupBy("filer_id").agg(
        total("total").alias("total"),
        F.sum("gifts").alias("gifts"),
        F.max_by(F.trim("filer"), F.when(present("filer").isNotNull(), F.struct("latest", "filer"))).alias("row_name"),
    )
    best = top_n(sums, max(1, limit), [F.desc("total"), F.asc("filer_id")])
    if profiles is not None:
        best = best.join(top_profile(profiles).select("filer_id", F.col("name").alias("profile_name"), "slug"), "filer_id", "left")
        return best.withColumn("name", F.coalesce("profile_name", "row_name")).drop("profile_name", "row_name")
    return best.withColumnRenamed("row_name", "name")


def payee_leaderboard(txn: DataFrame, filers: list | None, start: str | None = None, end: str | None = None, limit: int = 200) -> DataFrame:
    """Payees of some committees, grouped whatever their case; no committees, no rows."""
    name = present("contributor_payee")
    rows = scoped(txn.filter((F.col("tran_type") == "E") & name.isNotNull()), start, end, filers or [])
    spelt = rows.groupBy(name.alias("spelling")).agg(total("amount").alias("total"), F.count(F.lit(1)).alias("payments"))
    sums = spelt.groupBy(F.lower("spelling").alias("payee_key")).agg(F.min("spelling").alias("name"), total("total").alias("total"), F.sum("payments").alias("payments"))
    return top_n(sums, max(1, limit), [F.desc("total"), F.asc("payee_key")])


def daily_contributions(txn: DataFrame, start: str | None, end: str | None, filers: list | None = None) -> DataFrame:
    """Cash gifts by day; a missing bound yields no rows, a day without gifts no row."""
    rows = txn.filter(is_cash_gift() & F.col("tran_date").between(F.lit(start or None).cast("date"), F.lit(end or None).cast("date")))
    return scoped(rows, filers=filers).groupBy("tran_date").agg(total("amount").alias("total"), F.count(F.lit(1)).alias("gifts"))


def pulse_donors(rows: DataFrame, start: str, before: str, donors: int = 10, details: int = 10) -> tuple[DataFrame, DataFrame]:
    """Top donors of a window (start included, before excluded) and each one's top committees.

    Totals are netted per donor and committee first; pairs that net to nothing or less are left out, and pooled rows.
    """
    window = rows.filter((F.col("tran_date") >= F.lit(start).cast("date")) & (F.col("tran_date") < F.lit(before).cast("date")) & ~F.lower("label").like("miscellaneous %"))
    pairs = summed(window, "filer_id").drop("donor_id", "gifts").filter("total > 0")
    sums = pairs.groupBy("donor_key").agg(F.min("name").alias("name"), total("total").alias("total"), F.count(F.lit(1)).alias("committees"))
    best = top_n(sums, donors, [F.desc("total"), F.asc("donor_key")])
    more = top_n(pairs.join(best.select("donor_key"), "donor_key"), details, [F.desc("total"), F.asc("filer_id")], ["donor_key"])
    return best, more


def donor_profile_years(txn: DataFrame, members: list) -> DataFrame:
    """By year: given (contributions of any kind less refunds, not below 0), received (expenditures paid to the donor)."""
    rows = txn.filter(F.col("donor_id").isin(*members) & F.col("tran_date").isNotNull())
    return rows.groupBy(F.year("tran_date").alias("year")).agg(
        F.greatest((total_if(F.col("tran_type") == "C", "amount") - total_if(is_refund(), "amount")).cast(MONEY), F.lit(0).cast(MONEY)).alias("given"),
        total_if(F.col("tran_type") == "E", "amount").alias("received"),
    )


def donor_profile_recipients(txn: DataFrame, members: list, limit: int = 15) -> DataFrame:
    """Committees that the donor gave most to, netted; refunds count in no number of gifts."""
    rows = txn.filter(F.col("donor_id").isin(*members) & ((F.col("tran_type") == "C") | is_refund()))
    sums = rows.groupBy("filer_id").agg(
        (total_if(F.col("tran_type") == "C", "amount") - total_if(is_refund(), "amount")).cast(MONEY).alias("total"), F.count(F.when(F.col("tran_type") == "C", 1)).alias("gifts")
    )
    return top_n(sums.filter("total > 0"), limit, [F.desc("total"), F.asc("filer_id")])


def committee_names(ids: DataFrame, profiles: DataFrame) -> DataFrame:
    """Names of ids: the profile of the id itself, else one whose ``filer_ids`` holds it, else none."""
    exact = top_profile(profiles).select("filer_id", F.col("name").alias("name"))
    first = ids.join(exact, "filer_id", "left")
    missing = ids.join(exact, "filer_id", "left_anti")
    member = profiles.select(F.explode("filer_ids").alias("filer_id"), F.struct(F.col("slug"), F.col("name")).alias("p")).join(missing, "filer_id").groupBy("filer_id").agg(F.min("p").alias("p"))
    return first.join(member, "filer_id", "left").select("filer_id", F.coalesce("name", "p.name").alias("name"))


def identity_rollup(donors: DataFrame, identity: DataFrame) -> DataFrame:
    """Totals of each entity over its members."""
    return donors.join(identity, "donor_id", "left").groupBy(F.coalesce("entity_id", "donor_id").alias("entity_id")).agg(
        total("total_given").alias("total_given"), F.sum("gift_count").alias("gift_count"), F.count(F.lit(1)).alias("members"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )


def mode_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value that is not blank, the smallest of equals."""
    counts = df.filter(present(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def donor_rollup(txn: DataFrame, modes: tuple[str, ...] = ("book_type",)) -> DataFrame:
    """Per donor: given, in kind, received, gifts, first and last date, and the modes of some columns."""
    sums = txn.filter("donor_id is not null").groupBy("donor_id").agg(
        total_if(is_cash_gift(), "amount").alias("total_given"),
        total_if((F.col("tran_type") == "C") & is_in_kind(), "amount").alias("total_inkind"),
        total_if(F.col("tran_type") == "E", "amount").alias("total_received"),
        F.count(F.when(F.col("tran_type") == "C", 1)).alias("gift_count"),
        F.min("tran_date").alias("first_date"),
        F.max("tran_date").alias("last_date"),
    )
    for c in modes:
        sums = sums.join(mode_of(txn.filter("donor_id is not null"), "donor_id", c), "donor_id", "left")
    return sums


def year_sums(rows: DataFrame) -> DataFrame:
    """Netted sums by year (0 undated), committee and donor: the unit of the incremental caches."""
    return rows.groupBy(F.coalesce(F.year("tran_date"), F.lit(0)).alias("yr"), "filer_id", "donor_key", "label").agg(total("total").alias("total"), F.sum("gifts").alias("gifts"))


def year_totals(sums: DataFrame) -> DataFrame:
    return sums.groupBy("yr", "donor_key").agg(total("total").alias("total"), F.sum("gifts").alias("gifts"))


def label_entities(txn: DataFrame) -> DataFrame:
    """Each label's entity: the one that gave the most under it; of none that gave, the one with most rows."""
    rows = txn.filter("donor_id is not null").groupBy(F.col("contributor_payee").alias("label"), "donor_id").agg(total_if(is_cash_gift(), "amount").alias("given"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy("label").agg(F.max_by("donor_id", F.struct("given", "n", F.col("donor_id"))).alias("entity_id"))


def rekey(items: DataFrame, entities: DataFrame, name: str = "name", value: str = "total", by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A ranked list of names summed anew by entity, sorted by the rounded sum, and cut to its former length."""
    by = by or []
    rows = items.join(entities.select(F.col("label").alias(name), "entity_id"), name, "left").withColumn("key", F.coalesce("entity_id", F.concat(F.lit("name:"), F.lower(name))))
    sums = rows.groupBy(*by, "key").agg(F.max_by(name, F.struct(value, name)).alias(name), total(value).alias(value))
    order = [F.desc(F.round(value, 2)), F.asc("key")]
    return top_n(sums, limit, order, by) if limit else sums


def merge_case(items: DataFrame, name: str = "name", value: str = "total") -> DataFrame:
    """Lists of several years merged whatever the names' case."""
    return items.groupBy(F.lower(name).alias("key")).agg(F.min(name).alias(name), total(value).alias(value))


def refunds_of(txn: DataFrame) -> DataFrame:
    return txn.filter((F.col("tran_type") == "OD") & (F.col("sub_type") == V.REFUND))
