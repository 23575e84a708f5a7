"""The canonical columns that operators work on, and the mapping of any star schema to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import values as V
from .functions.text import blank

#: Of a transaction; operators use those that they need.
TRANSACTION = ("tran_id", "filer_id", "filer", "donor_id", "contributor_payee", "contributor_payee_canonical", "tran_date", "filed_date", "amount", "tran_type", "sub_type", "book_type", "state")


@dataclass
class Mapping:
    """Canonical names and what gives them: columns or expressions of the source."""

    columns: dict[str, Column | str] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in self.columns.items()])


def with_missing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with empty text columns for the names that it lacks."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


# Predicates of transactions.
def is_in_kind() -> Column:
    return blank("sub_type").isin(*V.IN_KIND)


def is_cash_gift() -> Column:
    """A contribution that is none of the in-kind sub-types."""
    return (F.col("tran_type") == "C") & ~is_in_kind()


def is_refund() -> Column:
    return (F.col("tran_type") == "OD") & (F.col("sub_type") == V.REFUND)


def is_adjustment() -> Column:
    return (F.col("tran_type") == "O") & (F.col("sub_type") == V.BALANCE_ADJUSTMENT)


def is_statement_contribution() -> Column:
    return (F.col("tran_type") == "C") & blank("sub_type").isin(*V.STATEMENT_CONTRIBUTIONS)


def is_statement_expenditure() -> Column:
    return (F.col("tran_type") == "E") & blank("sub_type").isin(*V.STATEMENT_EXPENDITURES)


def moves_cash() -> Column:
    cash_in = (F.col("tran_type") == "C") & blank("sub_type").isin(*V.CASH_CONTRIBUTIONS)
    cash_out = (F.col("tran_type") == "E") & blank("sub_type").isin(*V.CASH_EXPENDITURES)
    return cash_in | cash_out | F.col("tran_type").isin("OR", "OD") | is_adjustment()


def in_state(home: str = "OR") -> Column:
    s = F.upper(F.trim(blank("state")))
    return s.isin("", home)


def signed_amount() -> Column:
    """+ contributions, other receipts and adjustments; - expenditures and other disbursements; 0 for the rest."""
    up = F.col("tran_type").isin("C", "OR") | is_adjustment()
    return F.when(up, F.col("amount")).when(F.col("tran_type").isin("E", "OD"), -F.col("amount")).otherwise(F.lit(0)).cast("decimal(18,2)")


def within(start: str | None, end: str | None, column: str = "tran_date") -> Column | None:
    """Both bounds included; a bound that is None or '' doesn't count; rows without a date fail any bound."""
    tests = [F.col(column) >= F.lit(start).cast("date")] if start else []
    tests += [F.col(column) <= F.lit(end).cast("date")] if end else []
    return tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else None
