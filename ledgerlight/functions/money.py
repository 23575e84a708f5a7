"""Arithmetic on money and votes as Column expressions. Money is decimal(18,2); rounding is half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import C, _c

MONEY = "decimal(18,2)"


def total(x: C) -> Column:
    return F.sum(_c(x)).cast(MONEY)


def total_if(condition: Column, x: C) -> Column:
    return F.coalesce(F.sum(F.when(condition, _c(x))), F.lit(0)).cast(MONEY)


def known_total(x: C) -> Column:
    """Null if any part is null."""
    return F.when(F.count(_c(x)) == F.count(F.lit(1)), F.sum(_c(x))).cast(MONEY)


def deflate(amount: C, year: C) -> Column:
    """In the base year's dollars; as it is for years without an index."""
    index = F.create_map(*[F.lit(x) for y, v in V.CPI.items() for x in (y, v)])
    return F.coalesce(_c(amount).cast("double") * V.CPI[V.CPI_BASE] / F.try_element_at(index, _c(year)), _c(amount).cast("double"))


def growth_percent(now: C, before: C) -> Column:
    """Percent to one place, half to even; from nothing 999 if there is something, else 0."""
    n, b = _c(now).cast("double"), _c(before).cast("double")
    return F.when(b > 0, F.bround((n - b) / b * 100, 1)).otherwise(F.when(n > 0, 999.0).otherwise(0.0))


def margin_points(first: C, second: C, votes: C) -> Column:
    return F.round(F.when(_c(votes) != 0, (_c(first) - F.coalesce(_c(second), F.lit(0))) * 100 / _c(votes)).cast("decimal(18,6)"), 2).cast(MONEY)


def clamp(x: int | None, low: int, high: int, default: int) -> int:
    return max(low, min(high, default if x is None else x))


def close(a: C, b: C, within: str = "0.01") -> Column:
    return F.abs(_c(a) - _c(b)) <= F.lit(within).cast("decimal(18,4)")


def self_consistent(within: str = "0.01") -> Column:
    """A statement's lines add up to its ending balance."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = z("beginning_balance") + z("contributions") + z("other_receipts") + z("loans_received") + z("balance_adjustments")
    return close(made - z("expenditures") - z("other_disbursements") - z("loan_payments"), z("ending_cash_balance"), within)


def severity(delta: C) -> Column:
    d = F.abs(_c(delta))
    return F.when(d > 1000, "HIGH").when(d > 10, "MEDIUM").otherwise("LOW")
