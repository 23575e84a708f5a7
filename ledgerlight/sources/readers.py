"""Landed files as DataFrames: exports, shards, results, statements and pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import values as V
from ..functions.dates import parse_date
from ..functions.money import MONEY
from ..functions.text import clean_id, money, sub_type_tran_type
from ..schema import with_missing
from ..session import ship

# What files begin with.
MAGIC = {"d0cf11e0": "xls", "504b0304": "xlsx"}
SHARD_SCHEMA = ", ".join(f"`{c}` string" for c in ("tran_id", "original_id", "tran_status", "tran_date", "filed_date", "amount", "contributor_payee", "sub_type", "tran_type", "filer_id", "filer"))


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, length and kind (xls, xlsx, html, other) of each file by its first bytes."""
    files = spark.read.format("binaryFile").load(path)
    head = F.lower(F.hex(F.substring("content", 1, 4)))
    kinds = F.create_map(*[F.lit(x) for pair in MAGIC.items() for x in pair])
    page = F.lower(F.decode(F.substring("content", 1, 512), "ISO-8859-1")).rlike(r"^\s*<(!doctype|html|table)")
    return files.select("path", "length", F.coalesce(F.try_element_at(kinds, head), F.when(page, "html").otherwise("other")).alias("kind"))


def renamed(df: DataFrame) -> DataFrame:
    """Headers trimmed, lower case, under their canonical names; of two that become one, the first stays."""
    seen, out = set(), []
    for c in df.columns:
        name = V.HEADERS.get(c.strip().lower(), c.strip().lower())
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def exports(spark: SparkSession, path: str) -> DataFrame:
    """All-text exports (CSV) with their file's name, transaction type, and no truncated copies.

    The type is the file name's prefix, else that of the sub-type. A file of a filer at the export's cap is left out: its parts are there too.
    """
    df = renamed(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    df = with_missing(df.withColumn("source_file", F.col("_metadata.file_name")), "sub_type")
    size = F.count(F.lit(1)).over(W.partitionBy("source_file"))
    df = df.withColumn("_n", size).filter(~((F.col("_n") >= 4999) & F.lower("source_file").startswith("filer"))).drop("_n")
    prefix = F.upper(F.regexp_extract("source_file", r"^([A-Za-z]+)_", 1))
    return df.withColumn("tran_type", F.when(prefix.isin(*V.TRAN_TYPES), prefix).otherwise(sub_type_tran_type("sub_type")))


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of xlsx files as maps of text, one task's files at a time; needs openpyxl on the workers."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for files in batches:
            for p, content in zip(files["path"], files["content"], strict=True):
                sheet = pd.read_excel(io.BytesIO(content), dtype=str).fillna("")
                yield pd.DataFrame({"path": p, "row": [dict(r) for _, r in sheet.iterrows()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row map<string,string>")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """All yearly shards as text; a folder without any is an empty table."""
    try:
        return spark.read.option("header", True).schema(SHARD_SCHEMA).option("enforceSchema", False).csv(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SHARD_SCHEMA)


def typed(df: DataFrame) -> DataFrame:
    """Text columns cast to what the table holds; what doesn't parse is null."""
    casts: dict[str, Column] = {}
    for c in df.columns:
        if c in ("tran_id", "original_id"):
            casts[c] = clean_id(c).try_cast("bigint")
        elif c.endswith("_date"):
            casts[c] = parse_date(c)
        elif c in ("amount", "aggregate_amount"):
            casts[c] = money(c)
        else:
            casts[c] = F.nullif(F.col(c), F.lit(""))
    return df.select(*[e.alias(c) for c, e in casts.items()])


def election_results(spark: SparkSession, path: str) -> DataFrame:
    """Results with numbers and flags coerced; rows of no year left out."""
    df = spark.read.option("header", True).csv(path)
    flag = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("1", "t", "true", "y", "yes")
    whole = lambda c: F.regexp_replace(F.col(c), r"[,]|\.0+$", "").try_cast("int")
    kinds = {"year": whole, "votes": whole, "pct": lambda c: money(c), "won": flag, "is_measure": flag}
    df = df.select(*[(kinds[c](c) if c in kinds else F.nullif(F.trim(c), F.lit(""))).alias(c) for c in df.columns])
    return df.filter(F.coalesce("year", F.lit(0)) != 0)


def blob(spark: SparkSession, folder: str, key: str, required: bool = False) -> DataFrame | None:
    """A published table; None, or an error if it is required, where there is none."""
    try:
        return spark.read.parquet(f"{folder}/{key}")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        if required:
            raise LookupError(f"{key} is not published") from error
        return None


def filer_rows(df: DataFrame, filer_id: str) -> DataFrame:
    return df.filter(F.col("filer_id") == filer_id)


def verification_rows(*frames: DataFrame, key: str = "tran_id") -> DataFrame:
    """Rows of several exports, each id once: that of the first frame that has it."""
    rows = frames[0].withColumn("_f", F.lit(0))
    for n, f in enumerate(frames[1:], 1):
        rows = rows.unionByName(f.withColumn("_f", F.lit(n)), allowMissingColumns=True)
    order = W.partitionBy(key).orderBy("_f", *[c for c in frames[0].columns if c != key])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_f")


def windows(spark: SparkSession, start: str, end: str, days: int = 7) -> DataFrame:
    """first_day and last_day of windows that tile a range."""
    out = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL {days} DAYS)) AS first_day")
    return out.withColumn("last_day", F.least(F.date_add("first_day", days - 1), F.lit(end).cast("date")))


def split_window(count: Callable[..., int], start: date, end: date, cap: int, kinds: tuple[str, ...] = V.TRAN_TYPES) -> list[dict]:
    """Windows whose counts stay below a cap: by type, then halves of the dates, then amount bands, then name prefixes."""
    done, todo = [], [{"kind": k, "start": start, "end": end, "band": None, "prefix": None} for k in kinds]
    while todo:
        w = todo.pop()
        n = count(**w)
        if not n:
            continue
        if n < cap:
            done.append(w | {"n": n})
        elif w["start"] < w["end"]:
            middle = w["start"] + (w["end"] - w["start"]) // 2
            todo += [w | {"end": middle}, w | {"start": middle + timedelta(days=1)}]
        elif w["band"] is None:
            todo += [w | {"band": b} for b in V.AMOUNT_BANDS]
        elif w["prefix"] is None:
            todo += [w | {"prefix": p} for p in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
        else:
            done.append(w | {"n": n, "over": True})
    return done


# Pages.
AMOUNT = r"(\()?\s*(-\s*)?\$\s*(-?[\d,]+(?:\.\d+)?)\s*(\))?"


def dollar(page: str | None, label: str, default: float | None = None, start: str | None = None, end: str | None = None) -> float | None:
    """The amount that follows a label, in its own table row; parentheses or a minus make it negative.

    ``start`` and ``end`` bound the search to what is between two anchors.
    """
    text = page or ""
    if start is not None:
        m = re.search(re.escape(start), text, re.I)
        if not m:
            return default
        text = text[m.end() :]
    if end is not None:
        m = re.search(re.escape(end), text, re.I)
        text = text[: m.start()] if m else text
    for m in re.finditer(re.escape(label), text, re.I):
        row = re.split(r"(?i)</?tr\b", text[m.end() :], maxsplit=1)[0]
        if a := re.search(AMOUNT, re.sub(r"<[^>]*>", " ", row)):
            value = float(a[3].replace(",", ""))
            return -value if a[2] or (a[1] and a[4]) else value
    return default


def table_rows(page: str | None) -> list[list[str]]:
    """The cells' text of each table row."""
    out = []
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</table|</tr|\Z)", page or ""):
        cells = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", c)).split()) for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]|\Z)", row)]
        if cells:
            out.append(cells)
    return out


def statement_pages(pages: DataFrame, labels: dict[str, str], key: str = "filer_id", html: str = "html") -> DataFrame:
    """One column of money per label of account-summary pages, by Arrow batches."""
    ship(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key]} | {name: [dollar(h, label) for h in b[html]] for name, label in labels.items()})

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(key, html).mapInPandas(read, f"{key} {kind}, " + ", ".join(f"{n} double" for n in labels))
    return out.select(key, *[F.col(n).cast(MONEY).alias(n) for n in labels])


def listing_pages(pages: DataFrame, columns: list[str], key: str = "page", html: str = "html", header: bool = True) -> DataFrame:
    """Rows of the tables of listing pages (amendments, histories, certificates, persons), short rows filled with blanks."""
    ship(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, h in zip(b[key], b[html], strict=True):
                rows = [r for r in table_rows(h)[1 if header else 0 :] if len(r) <= len(columns)]
                if rows:
                    yield pd.DataFrame([[k, n, *r, *[""] * (len(columns) - len(r))] for n, r in enumerate(rows)], columns=[key, "row", *columns])

    schema = T.StructType([pages.schema[key], T.StructField("row", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in columns]])
    return pages.select(key, html).mapInPandas(read, schema)


def roster(pages: DataFrame, columns: list[str], least: int, most: int, key: str = "page") -> DataFrame:
    """A roster's rows; raises if their number is implausible or a name comes twice."""
    rows = listing_pages(pages, columns, key)
    n, distinct = rows.count(), rows.select(columns[0]).distinct().count()
    if not least <= n <= most or distinct != n:
        raise ValueError(f"the roster has {n} rows, {distinct} names")
    return rows
