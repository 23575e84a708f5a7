"""Browsing, exports and read-only SQL."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.money import clamp
from ..functions.text import csv_cell, display_name
from ..schema import within


def holds(column: str, term: str) -> Column:
    """Whether a text holds a term, whatever the case; % and _ in the term are wildcards."""
    return F.col(column).ilike(f"%{term}%")


def quoted_term(term: str) -> str:
    """A term for an export's filter: backslashes and quotes escaped, wildcards not."""
    return term.replace("\\", "\\\\").replace('"', '\\"')


def spaced(term: str) -> str:
    """White space as a wildcard."""
    return re.sub(r"\s+", "%", term.strip())


def filters(
    filer: str | None = None,
    payee: str | None = None,
    donors: list | None = None,
    tran_type: str | None = None,
    sub_type: str | None = None,
    book_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    amount_least: str | None = None,
    amount_most: str | None = None,
) -> list[Column]:
    """The predicates that are on: None and '' are off. Names match canonical or raw; a donor's group beats a payee's text."""
    out = []
    if filer:
        out.append(holds("filer_canonical", filer) | holds("filer", filer))
    if donors:
        out.append(F.col("donor_id").isin(*donors))
    elif payee:
        out.append(holds("contributor_payee_canonical", payee) | holds("contributor_payee", payee))
    for column, value in (("tran_type", tran_type), ("sub_type", sub_type), ("book_type", book_type)):
        if value:
            out.append(F.col(column) == value)
    dates = within(date_from, date_to)
    if dates is not None:
        out.append(dates)
    if amount_least not in (None, ""):
        out.append(F.col("amount") >= F.lit(amount_least).cast("decimal(18,2)"))
    if amount_most not in (None, ""):
        out.append(F.col("amount") <= F.lit(amount_most).cast("decimal(18,2)"))
    return out


def narrowed(txn: DataFrame, **on) -> DataFrame:
    for f in filters(**on):
        txn = txn.filter(f)
    return txn


def page(txn: DataFrame, sort: str | None = None, ascending: bool = False, limit: int | None = 100, offset: int | None = 0, **on) -> DataFrame:
    """One page in a listed order (the date unless listed), nulls last both ways, then the largest id first."""
    column = sort if sort in V.SORTS else "tran_date"
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return narrowed(txn, **on).orderBy(order, F.desc("tran_id")).offset(max(0, offset or 0)).limit(clamp(limit, 1, V.PAGE_MOST, 100))


def displayed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"filer_name": display_name("filer_canonical", "filer", number="filer_id"), "payee_name": display_name("contributor_payee_canonical", "contributor_payee")}
    )


def export(txn: DataFrame, limit: int = V.EXPORT_ROWS, after: str | int | None = None, **on) -> tuple[DataFrame, bool]:
    """Rows in the order of their ids from after one, and whether there are more."""
    rows = narrowed(txn, **on)
    if after is not None:
        rows = rows.filter(F.col("tran_id") > after)
    rows = rows.orderBy("tran_id")
    return rows.limit(limit), rows.limit(limit + 1).count() > limit


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_cell(c) for c in rows.columns]).alias("line"))


def recent(txn: DataFrame, n: int = 10_000) -> DataFrame:
    return txn.orderBy(F.desc_nulls_last("filed_date"), F.desc("tran_id")).limit(n)


def public_view(txn: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that the public may query, under their public names."""
    return txn.select(*[F.col(c).alias(n) for c, n in names.items()])


def validated(text: str) -> str:
    """The one SELECT of a text: one closing semicolon is dropped; raises for anything else."""
    sql = re.sub(r";\s*$", "", text.strip()).strip()
    bare = re.sub(r"^\s*(--[^\n]*\n|/\*[\s\S]*?\*/)\s*", "", sql).strip()
    if not sql or ";" in sql or not re.match(r"(select|with)\b", bare, re.I) or re.search(rf"\b({V.WRITING_WORDS})\b", bare, re.I):
        raise ValueError("only one SELECT is allowed")
    return sql


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame], limit: int = V.SQL_ROWS, seconds: float = 30.0) -> tuple[DataFrame, bool]:
    """A reader's SELECT over listed views: the first rows, and whether there are more. The views are there for its time only.

    The query runs once, and its jobs are cancelled after ``seconds``, with a TimeoutError.
    """
    sql = validated(text)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    tag, late, sc = f"reader-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext
    held = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(tag)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(tag, "a reader's query", interruptOnCancel=True)
    try:
        timer.start()
        rows = spark.sql(f"SELECT * FROM ({sql}) q LIMIT {limit + 1}")
        schema, got = rows.schema, rows.collect()  # limit + 1 at most
        return spark.createDataFrame(got[:limit], schema), len(got) > limit
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds:g} seconds") from error
        raise
    finally:
        timer.cancel()
        for key, value in held.items():
            sc.setLocalProperty(key, value)
        for name in views:
            spark.catalog.dropTempView(name)
