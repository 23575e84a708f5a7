"""Filings against annual statements: discrepancies, evidence gates and generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import values as V
from ..functions.money import MONEY, close, known_total, self_consistent, severity, total, total_if
from ..functions.text import row_digest, scope_digest
from ..schema import signed_amount


def combined_statements(statements: DataFrame, scopes: DataFrame) -> DataFrame:
    """Annual statements of committees of several ids, for years that all have; an unknown part leaves these sums unknown.

    ``scopes``: scope, filer_id. Plain fields count an unknown as nothing.
    """
    size = scopes.groupBy("scope").agg(F.countDistinct("filer_id").alias("size"))
    rows = statements.join(scopes, "filer_id").join(size, "scope")
    fields = [c for c in V.STATEMENT_FIELDS if c in statements.columns]
    sums = [(known_total(c) if c in V.UNKNOWN_STAYS else total(F.coalesce(F.col(c), F.lit(0)))).alias(c) for c in fields]
    out = rows.groupBy("scope", "year").agg(F.countDistinct("filer_id").alias("have"), F.max("size").alias("size"), *sums, F.min("scrape_ts").alias("first_ts"), F.max("scrape_ts").alias("last_ts"))
    return out.filter("have = size").drop("have", "size")


def opening_balances(earliest: DataFrame, scopes: DataFrame) -> DataFrame:
    """Merged opening balances where every member has one: smallest year, sum, and whether all reach their first year."""
    size = scopes.groupBy("scope").agg(F.countDistinct("filer_id").alias("size"))
    out = earliest.join(scopes, "filer_id").groupBy("scope").agg(
        F.countDistinct("filer_id").alias("have"), F.min("earliest_year").alias("earliest_year"), total("beginning_balance").alias("beginning_balance"), F.bool_and("reached_earliest").alias("reached_earliest")
    )
    return out.join(size, "scope").filter("have = size").drop("have", "size")


def newest_statements(statements: DataFrame) -> DataFrame:
    """Each filer's last year."""
    rest = [c for c in statements.columns if c != "filer_id"]
    best = statements.groupBy("filer_id").agg(F.max_by(F.struct(*rest), F.struct("year", "scrape_ts")).alias("s"))
    return best.select("filer_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def ours_by_year(txn: DataFrame) -> DataFrame:
    """What filings add up to, line by line as statements have them."""
    t = F.col("tran_type")
    contributions = (t == "C") & F.col("sub_type").isin(*V.STATEMENT_CONTRIBUTIONS)
    expenditures = (t == "E") & F.col("sub_type").isin(*V.STATEMENT_EXPENDITURES)
    in_kind = (t == "C") & F.col("sub_type").isin(*V.IN_KIND)
    return txn.filter("tran_date is not null").groupBy("filer_id", F.year("tran_date").alias("year")).agg(
        total_if(contributions, "amount").alias("contributions"),
        total_if(expenditures | in_kind, "amount").alias("expenditures"),
        total_if(t == "OR", "amount").alias("other_receipts"),
        total_if(t == "OD", "amount").alias("other_disbursements"),
        total_if((t == "O") & (F.col("sub_type") == V.BALANCE_ADJUSTMENT), "amount").alias("balance_adjustments"),
        total(signed_amount()).alias("net"),
    )


LINES = ("contributions", "expenditures", "other_receipts", "other_disbursements", "balance_adjustments")


def yearly_discrepancies(ours: DataFrame, theirs: DataFrame, within: str = "0.01") -> DataFrame:
    """Per filer and year of either side: the difference of each line, whether a side is missing, and the severity."""
    a = ours.select("filer_id", "year", *[F.col(c).alias(f"our_{c}") for c in LINES], F.lit(True).alias("_a"))
    b = theirs.select("filer_id", "year", *[F.col(c).alias(f"their_{c}") for c in LINES], F.lit(True).alias("_b"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = a.join(b, ["filer_id", "year"], "full").withColumns({f"{c}_delta": (z(f"our_{c}") - z(f"their_{c}")).cast(MONEY) for c in LINES})
    worst = F.greatest(*[F.abs(f"{c}_delta") for c in LINES])
    off = worst > F.lit(within).cast("decimal(18,4)")
    state = F.when(F.col("_b").isNull(), "unchecked").when(F.col("_a").isNull(), "ours_missing").when(off, "flagged").otherwise("agrees")
    return out.withColumns({"state": state, "severity": F.when(state == "flagged", severity(worst))}).select("filer_id", "year", *[f"{c}_delta" for c in LINES], "state", "severity")


def tally(rows: DataFrame, column: str = "state") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def refusals(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def filed_by(txn: DataFrame, cutoffs: list[str]) -> DataFrame:
    """A year's net under several filed-by dates."""
    return txn.groupBy("filer_id").agg(*[total_if(F.col("filed_date") <= F.lit(c).cast("date"), signed_amount()).alias(f"by_{c}") for c in cutoffs])


def around_capture(txn: DataFrame, captures: DataFrame) -> DataFrame:
    """Net filed strictly before the capture's day, and on it, where the order within the day is unknown."""
    rows = txn.join(captures.select("filer_id", "captured_on"), "filer_id")
    return rows.groupBy("filer_id").agg(total_if(F.col("filed_date") < F.col("captured_on"), signed_amount()).alias("before"), total_if(F.col("filed_date") == F.col("captured_on"), signed_amount()).alias("on_the_day"))


def exempt_loans_suppressed(txn: DataFrame, statements: DataFrame) -> DataFrame:
    """Rows without exempt loans of years whose statement reports none, adds up and is not blank."""
    blank = F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0))) for c in ("contributions", "expenditures", "other_receipts", "other_disbursements", "ending_cash_balance")]) == 0
    none = (F.coalesce("loans_received_exempt", F.lit(-1)) == 0) & (F.coalesce("loan_payments_exempt", F.lit(-1)) == 0)
    years = statements.filter(none & self_consistent() & ~blank).select("filer_id", "year").distinct()
    exempt = F.col("sub_type").isin("Loan Received (Exempt)", "Loan Payment (Exempt)")
    marked = txn.withColumn("year", F.year("tran_date"))
    kept = marked.filter(exempt).join(years, ["filer_id", "year"], "left_anti")
    return marked.filter(~exempt).unionByName(kept.select(marked.columns)).drop("year")


def non_exempt_corrections(ours: DataFrame, statements: DataFrame) -> DataFrame:
    """What must be added to our non-exempt loans to reach the reported ones."""
    return ours.join(statements, ["filer_id", "year"], "left").select(
        "filer_id", "year", F.when(F.col("loans_received").isNotNull(), F.col("loans_received") - F.col("our_loans")).otherwise(F.lit(0)).cast(MONEY).alias("correction")
    )


def anchored(statements: DataFrame, nets: DataFrame) -> DataFrame:
    """Yearly nets from the first statement's year on, with its opening balance."""
    first = statements.groupBy("filer_id").agg(F.min_by(F.struct("year", "beginning_balance"), "year").alias("f"))
    return nets.join(first, "filer_id").filter(F.col("year") >= F.col("f.year")).select("filer_id", "year", "net", F.col("f.beginning_balance").alias("anchor"))


def ghost_rows(steps: DataFrame) -> DataFrame:
    """Rows that carry a certificate's restatement (filer_id, year, step) on the year's first day."""
    return steps.select(
        "filer_id", F.make_date("year", F.lit(1), F.lit(1)).alias("tran_date"), F.abs("step").cast(MONEY).alias("amount"), F.lit("O").alias("tran_type"), F.lit(V.BALANCE_ADJUSTMENT).alias("sub_type"), F.signum("step").cast("int").alias("sign")
    )


def closure_rows(balances: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows that reset a closed committee's balance: filer_id, first blank year, and minus what was left."""
    first = closed.groupBy("filer_id").agg(F.min("year").alias("year"))
    last = balances.join(first.withColumnRenamed("year", "closing"), "filer_id").filter("year < closing").groupBy("filer_id", "closing").agg(F.max_by("ending", "year").alias("ending"))
    return last.filter("ending <> 0").select("filer_id", F.col("closing").alias("year"), (-F.col("ending")).cast(MONEY).alias("amount"))


def completeness(counts: DataFrame, diffs: DataFrame) -> DataFrame:
    """Whether a filer's rows are all there: a row-level diff's verdict, unknown too, over the count survey's."""
    out = counts.select("filer_id", F.col("complete").alias("_count")).join(diffs.select("filer_id", F.col("complete").alias("_diff"), F.lit(True).alias("_has")), "filer_id", "full")
    return out.select("filer_id", F.when(F.col("_has"), F.col("_diff")).otherwise(F.col("_count")).alias("complete"))


def all_complete(rows: DataFrame, by: str = "scope") -> DataFrame:
    """Three-valued: false if any member's is, unknown if any is, else true."""
    any_false, any_null = F.bool_or(~F.col("complete")), F.count("complete") < F.count(F.lit(1))
    return rows.groupBy(by).agg(F.when(F.coalesce(any_false, F.lit(False)), False).when(any_null, F.lit(None).cast("boolean")).otherwise(True).alias("complete"))


def certified_absent(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Ids that every member of a scope certifies absent."""
    size = scopes.groupBy("scope").agg(F.countDistinct("filer_id").alias("size"))
    return rows.join(scopes, "filer_id").groupBy("scope", "tran_id").agg(F.countDistinct("filer_id").alias("have")).join(size, "scope").filter("have = size").select("scope", "tran_id")


def publishes_balance(rows: DataFrame) -> DataFrame:
    """Filers that file independent expenditures only publish none."""
    return rows.groupBy("filer_id").agg((~F.bool_and(F.col("filer_type") == "independent expenditure")).alias("balance_published"))


def cash_on_hand(balances: DataFrame) -> DataFrame:
    """All published balances together, and how many are left out."""
    shown = F.col("balance_published")
    return balances.agg(total_if(shown, "ending").alias("cash_on_hand"), F.count(F.when(~shown, 1)).alias("excluded"))


def broken_invariant(months: DataFrame, years: DataFrame, by: str = "filer_id") -> DataFrame:
    """Filers and years whose monthly nets don't add up to the yearly net: none, or the build is wrong."""
    sums = months.groupBy(by, F.substring("month", 1, 4).cast("int").alias("year")).agg(total("net").alias("months"))
    return sums.join(years, [by, "year"], "full").filter(~close(F.coalesce("months", F.lit(0)), F.coalesce("net", F.lit(0)), "0.005"))


def require_empty(rows: DataFrame, what: str) -> None:
    """Raises with some examples if there are rows."""
    found = rows.take(3)
    if found:
        raise ValueError(f"{what}: {found}")


def paired_captures(components: DataFrame, by: str = "scope") -> DataFrame:
    """Scopes all of whose components share snapshot, digest, range and version."""
    same = [F.countDistinct(c).alias(f"_{c}") for c in ("snapshot_id", "digest", "range", "version")]
    return components.groupBy(by).agg(*same).filter(" and ".join(f"_{c} = 1" for c in ("snapshot_id", "digest", "range", "version"))).select(by)


def current_evidence(evidence: DataFrame, captures: DataFrame) -> DataFrame:
    """Evidence collected strictly after its capture, of the same digest and range."""
    return evidence.alias("e").join(captures.alias("c"), "filer_id").filter("e.collected_at > c.captured_at and e.digest = c.digest and e.range = c.range").select("e.*")


def audit(details: DataFrame, months: DataFrame, by: str = "filer_id", threshold: str = "0.02") -> DataFrame:
    """Committee totals against their timelines: findings by check."""
    sums = months.groupBy(by).agg(total("contributions").alias("tl_in"), total("expenditures").alias("tl_out"))
    rows = details.join(sums, by, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = F.array(
        F.struct(F.lit("total_in").alias("check"), z("total_in").cast(MONEY).alias("ours"), z("tl_in").cast(MONEY).alias("expected")),
        F.struct(F.lit("total_out").alias("check"), z("total_out").cast(MONEY).alias("ours"), z("tl_out").cast(MONEY).alias("expected")),
    )
    out = rows.select(by, F.explode(checks).alias("x")).select(by, "x.*").withColumn("delta", (F.col("ours") - F.col("expected")).cast(MONEY))
    return out.filter(F.abs("delta") > F.lit(threshold).cast("decimal(18,4)")).withColumn("severity", severity("delta"))


def window_census(txn: DataFrame, start: str, end: str, kinds: list[str] | None = None, low: str | None = None, high: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows held in a window of dates, types, amounts and name prefix."""
    out = txn.filter(F.col("tran_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if kinds:
        out = out.filter(F.col("tran_type").isin(*kinds))
    if low is not None:
        out = out.filter(F.col("amount") >= F.lit(low).cast(MONEY))
    if high is not None:
        out = out.filter(F.col("amount") <= F.lit(high).cast(MONEY))
    if prefix:
        out = out.filter(F.upper("contributor_payee").startswith(prefix.upper()))
    return out.groupBy("filer_id").agg(F.count(F.lit(1)).alias("held"))


def ambiguous_scopes(scopes: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Filers of scopes that share a filer with another scope, or that have two owners: none of them may be published."""
    claims = F.size(F.collect_set("scope").over(W.partitionBy("filer_id")))  # scopes of one filer: few
    bad = scopes.withColumn("_n", claims).filter("_n > 1").select("scope")
    if owners is not None:
        bad = bad.unionByName(owners.groupBy("scope").agg(F.countDistinct("owner").alias("_n")).filter("_n > 1").select("scope"))
    return scopes.join(bad.distinct(), "scope", "left_semi")


def consistent_diffs(diffs: DataFrame) -> DataFrame:
    """Diff rows whose id sets fit: missing and held apart, surplus within held, counts as stated."""
    fits = ~F.arrays_overlap("missing", "held") & (F.size(F.array_except("surplus", "held")) == 0) & (F.size("missing") == F.col("n_missing")) & (F.size("surplus") == F.col("n_surplus"))
    return diffs.filter(fits)


def common_range(ranges: DataFrame, by: str = "scope") -> DataFrame:
    """The range that a scope's members share: the latest start to the earliest end."""
    return ranges.groupBy(by).agg(F.max("start").alias("start"), F.min("end").alias("end")).filter("start <= end")


def annual_treatment(rows: DataFrame, evidence: DataFrame, version: int) -> DataFrame:
    """Rows with evidence of the same digest, version and capture."""
    keys = ["filer_id", "digest", "capture_id"]
    return rows.join(evidence.filter(F.col("version") == version).select(*keys).distinct(), keys, "left_semi")


def counted_amendments(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """Early-era chains: which versions a statement counted, per filer, year and type.

    Of each chain the last version filed by the end of the following March counts; the answer is refused (null) unless the
    counted versions add up to what was reported.
    """
    deadline = F.make_date(F.col("year") + 1, F.lit(3), F.lit(31))
    by = ["filer_id", "year", "tran_type"]
    last = rows.filter(F.col("filed_date") <= deadline).withColumn("_n", F.row_number().over(W.partitionBy(*by, "chain").orderBy(F.desc("filed_date"), F.desc("tran_id")))).filter("_n = 1")
    sums = last.groupBy(*by).agg(total("amount").alias("counted"), F.count(F.lit(1)).alias("chains"))
    out = sums.join(reported, by)
    return out.select(*by, "chains", F.when(close("counted", "reported"), F.col("counted")).alias("counted"))


def gate(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose flag is true, not merely not false."""
    return rows.filter(F.coalesce(F.col(column), F.lit(False)))


def classify(rows: DataFrame) -> Column:
    return F.when(F.col("their_balance").isNull(), "unchecked").when(~F.col("paired"), "unpaired").when(F.col("stale"), "refresh").when(close("our_balance", "their_balance"), "agrees").when(~F.col("actionable"), "nonactionable").otherwise("flagged")


def snapshots(txn: DataFrame, superseded: DataFrame, start: str, end: str) -> DataFrame:
    """Per filer, what is held in a range of dates: number of rows, amount, superseded ids, and a digest that no row order changes."""
    held = txn.filter(F.col("tran_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    gone = superseded.groupBy("filer_id").agg(F.count(F.lit(1)).alias("superseded"))
    rows = held.withColumn("_e", row_digest("tran_id", "tran_date", "amount", "tran_type", "sub_type"))
    out = rows.groupBy("filer_id").agg(F.count(F.lit(1)).alias("held"), total("amount").alias("amount"), scope_digest("_e").alias("digest"))
    return out.join(gone, "filer_id", "left").fillna(0, ["superseded"])


def snapshot_id(files: DataFrame) -> str:
    """One name for a set of files by their paths' last parts and lengths."""
    cell = F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), F.col("length").cast("string"))
    return files.agg(scope_digest(cell)).first()[0]


def partition_sums(parts: DataFrame, parent: str = "parent", n: str = "n", child: str = "id") -> DataFrame:
    """Nodes of a coverage tree whose children's counts don't add up to their own."""
    sums = parts.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(child)).agg(F.sum(n).alias("children"))
    return parts.join(sums, child).filter(F.col(n) != F.col("children")).select(child, n, "children")
