"""Names, labels, addresses and ids as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import values as V

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: C) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def present(x: C) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_name(x: C) -> Column:
    """Lower case; all but word characters, hyphens and apostrophes to spaces; spaces collapsed."""
    return squeeze(F.regexp_replace(F.lower(F.trim(blank(x))), r"(?U)[^\w\s\-']", " "))


def _title(name: str) -> str:
    out = name.title()
    for pattern, word in V.TITLE_FIXES:
        out = re.sub(pattern, word, out, flags=re.I)
    return out.strip()


@F.pandas_udf(T.StringType())
def _titled(names: pd.Series) -> pd.Series:
    return names.map(_title)


def canonical_name(x: C) -> Column:
    """Title case as Python has it (after apostrophes and hyphens too), then acronyms and small words."""
    return _titled(normalize_name(x))


def slug(x: C) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)


def unique_slugs(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names with slugs; the 2nd, 3rd ... name (in order) of one slug gets _2, _3 ... where that is free.

    A made-up slug that another name has by itself moves on to the next free number.
    """
    base = names.select(name).distinct().withColumn("base", slug(name))
    n = F.row_number().over(W.partitionBy("base").orderBy(name))
    out = base.withColumn("slug", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string"))))
    taken = base.select(F.col("base").alias("taken")).distinct()
    clash = out.join(taken, (F.col("slug") == F.col("taken")) & (F.col("slug") != F.col("base")), "left")
    return clash.select(name, F.when(F.col("taken").isNull(), F.col("slug")).otherwise(F.concat("slug", F.lit("_"), F.substring(F.sha1(F.col(name)), 1, 6))).alias("slug"))


def normalize_label(x: C) -> Column:
    """No-break spaces to spaces, spaces collapsed, trimmed; the pooled label in its own spelling."""
    label = squeeze(F.replace(blank(x), F.lit("\u00a0"), F.lit(" ")))
    return F.when(F.lower(label) == V.POOLED.lower(), F.lit(V.POOLED)).otherwise(label)


def bucket_label(x: C) -> Column:
    """Pooled refunds join the pooled gifts."""
    return F.when(F.lower(_c(x)) == V.POOLED_REFUND.lower(), F.lit(V.POOLED)).otherwise(_c(x))


def is_pooled(x: C) -> Column:
    return F.lower(_c(x)) == V.POOLED.lower()


def donor_key(donor_id: C, label: C) -> Column:
    """label:... for the pooled label, else the donor's id, else name:..."""
    return F.when(is_pooled(label), F.concat(F.lit("label:"), _c(label))).otherwise(F.coalesce(_c(donor_id).cast("string"), F.concat(F.lit("name:"), F.lower(_c(label)))))


def display_label(label: C) -> Column:
    """Aggregate: a spelling of mixed case if there is one, else the smallest."""
    x = _c(label)
    return F.min_by(x, F.struct((F.upper(x) == x) | (F.lower(x) == x), x))


def depunctuate(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, r"(?U)[^\w\s]", " "))


def norm_name(x: C) -> Column:
    """LAST, FIRST turned round unless what follows the comma is a suffix; a trailing (id) dropped; plain lower case."""
    s = F.regexp_replace(F.trim(blank(x)), V.EMBEDDED_ID, "")
    parts = F.split(s, ",")
    last, first = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    flip = (F.size(parts) == 2) & (last != "") & (first != "") & ~s.rlike(r"\d") & ~depunctuate(F.lower(first)).isin(*V.NOT_GIVEN_NAMES)
    return depunctuate(F.lower(F.when(flip, F.concat_ws(" ", first, last)).otherwise(s)))


def zip5(x: C) -> Column:
    return F.substring(F.trim(blank(x)), 1, 5)


def norm_addr(addr: C, zip_code: C) -> Column:
    """Street without unit, words shortened, with the zip's five digits; '' if there is no street."""
    s = F.regexp_replace(F.lower(F.trim(blank(addr))), r"\b(apt|suite|ste|unit|#)\s*\S*\s*$", "")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    short = F.create_map(*[F.lit(w) for pair in V.STREET_WORDS.items() for w in pair])
    words = F.transform(F.split(squeeze(s), " "), lambda t: F.coalesce(F.try_element_at(short, t), t))
    street = F.array_join(F.filter(words, lambda t: t != ""), " ")
    return F.when(street == "", F.lit("")).otherwise(F.concat(street, F.lit("|"), zip5(zip_code)))


def norm_employer(x: C) -> Column:
    s = depunctuate(F.lower(blank(x)))
    return F.when(s.isin(*V.NO_EMPLOYER), F.lit("")).otherwise(s)


def alias_key(name: C, addr: C) -> Column:
    return F.concat(_c(name), F.lit("|"), _c(addr))


def soundex(x: C) -> Column:
    """Lower-case soundex of the letters; '' without any."""
    letters = F.regexp_replace(blank(x), "[^A-Za-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.lower(F.soundex(letters)))


def committee_eligible(name: C, book_type: C) -> Column:
    """Whether a name may be a committee's: by its type, or by how it reads if it is not a person's."""
    kind = blank(book_type)
    return kind.isin(*V.COMMITTEES) | (~kind.isin(*V.INDIVIDUALS) & blank(name).rlike(V.COMMITTEE_NAME))


def embedded_id(x: C) -> Column:
    return F.nullif(F.regexp_extract(blank(x), V.EMBEDDED_ID, 1), F.lit(""))


def clean_id(x: C) -> Column:
    """'123.0' to '123'; null words to ''."""
    s = F.trim(blank(x))
    return F.when(F.lower(s).isin(*V.NULL_WORDS), F.lit("")).otherwise(F.regexp_replace(s, r"\.0$", ""))


def money(x: C, unparsed: float | None = None, parentheses: bool = True) -> Column:
    """Money text as decimal(18,2): $ and commas dropped, accounting parentheses negative; what doesn't parse is ``unparsed``."""
    s = F.regexp_replace(F.trim(blank(x)), r"[$,]", "")
    if parentheses:
        s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    out = s.try_cast("decimal(18,2)")
    return out if unparsed is None else F.coalesce(out, F.lit(unparsed).cast("decimal(18,2)"))


def entity_id(key: C) -> Column:
    return F.concat(F.lit("d"), F.substring(F.sha1(_c(key)), 1, 12))


def identity_label(x: C) -> Column:
    return F.lower(F.regexp_replace(F.trim(blank(x)), r"\s+", " "))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def candidate_key(x: C) -> Column:
    """Letters only; initials and honorifics dropped."""
    words = _tokens(F.regexp_replace(F.lower(blank(x)), "[^a-z ]", " "))
    return F.array_join(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*V.HONORIFICS)), " ")


def _full_names(words: Column) -> Column:
    full = F.create_map(*[F.lit(w) for pair in V.NICKNAMES.items() for w in pair])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(full, t), t))


def nickname_key(x: C) -> Column:
    return F.array_join(_full_names(_tokens(candidate_key(x))), " ")


def historical_key(x: C) -> Column:
    """Nicknames in full, words in order."""
    words = F.filter(_full_names(_tokens(candidate_key(x))), lambda t: F.length(t) > 1)
    return F.array_join(F.array_sort(words), " ")


def norm_district(x: C) -> Column:
    return F.trim(F.regexp_replace(blank(x), r"\s*\(.*$", ""))


def district_number(x: C) -> Column:
    return F.nullif(F.regexp_extract(blank(x), r"(\d+)", 1), F.lit("")).cast("int")


def speaking_name(x: C, given: DataFrame | list[str]) -> Column:
    """SURNAME GIVEN turned round when the last word is a known given name and the first is not; ``given`` is a bounded list."""
    known = given if isinstance(given, list) else [r[0] for r in given.limit(10_000).collect()]
    words = _tokens(blank(x))
    first, last = F.lower(F.get(words, F.lit(0))), F.lower(F.get(words, F.size(words) - 1))
    names = F.array(*[F.lit(k.lower()) for k in known]) if known else F.array().cast("array<string>")
    turn = (F.size(words) > 1) & F.array_contains(names, last) & ~F.array_contains(names, first)
    turned = F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 1, 1))
    return F.array_join(F.when(turn, turned).otherwise(words), " ")


def committee_norm(x: C) -> Column:
    """For matching donors to committees: possessives closed, punctuation and one tail after another dropped."""
    s = F.regexp_replace(F.lower(F.trim(blank(x))), r"['’`]s\b", "s")
    s = squeeze(F.regexp_replace(s, r"[^a-z0-9\s]", ""))
    for tail in V.COMMITTEE_TAILS:
        s = F.trim(F.regexp_replace(s, f"{tail}$", ""))
    return s


def display_name(*columns: C, number: C | None = None, prefix: str = "Committee ", default: str = "Not reported") -> Column:
    """The first that is not blank, else the prefix with a number, else the default."""
    last = [F.concat(F.lit(prefix), _c(number).cast("string"))] if number is not None else []
    return F.coalesce(*[present(c) for c in columns], *last, F.lit(default))


def type_label(code: C) -> Column:
    labels = F.create_map(*[F.lit(w) for pair in V.CONTRIBUTOR_TYPES.items() for w in pair])
    s = F.trim(blank(code))
    return F.coalesce(F.try_element_at(labels, s), F.when(s != "", s), F.lit("Unknown"))


def sub_type_tran_type(sub_type: C) -> Column:
    kinds = F.create_map(*[F.lit(w) for kind, subs in V.SUB_TYPES.items() for s in subs for w in (s, kind)])
    return F.coalesce(F.try_element_at(kinds, _c(sub_type)), F.lit(""))


def leadership_tier(role: C) -> Column:
    """0 none, 1 presiding officers, 2 majority leaders and budget chairs, 3 other roles."""
    r = F.lower(blank(role))
    top = r.contains("speaker of the house") | (F.trim(r) == "senate president") | (r.contains("president") & ~r.contains("pro"))
    second = (r.contains("majority leader") & ~r.contains("deputy") & ~r.contains("assistant")) | r.contains("ways and means co-chair")
    return F.when(r == "", 0).when(top, 1).when(second, 2).otherwise(3)


def office_tier(office: C, statewide: list[str], legislative: list[str]) -> Column:
    o = _c(office)
    return F.when(present(o).isNull(), F.lit(None).cast("string")).when(o.isin(*statewide), "statewide").when(o.isin(*legislative), "legislative").otherwise("local")


def is_null_word(x: C) -> Column:
    return F.lower(F.trim(blank(x))).isin("", *V.NULL_WORDS)


def row_digest(*columns: C) -> Column:
    """A versioned encoding of the columns' cleaned values, for order-free digests of row sets."""
    cells = [F.when(is_null_word(c), F.lit("")).otherwise(F.trim(blank(c))) for c in columns]
    return F.concat(F.lit("v1"), *[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cells])


def scope_digest(encoded: C) -> Column:
    """Aggregate: one digest of a scope's rows that no order changes.

    The sums of the eight words of all rows' SHA-256, hashed: a scope of any size is summed in part like any total, never gathered.
    """
    h = F.sha2(_c(encoded), 256)
    words = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    return F.sha2(F.concat_ws(",", *[w.cast("string") for w in (F.count(F.lit(1)), *words)]), 256)


def csv_cell(x: C) -> Column:
    s = blank(x)
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
