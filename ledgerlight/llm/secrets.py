"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens. DataFrame functions only.

Fixed patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlaps, each kind on its own.

The battery adds spans of the kind ``random``. Candidates are runs of 20 or more of the characters of base64 and its URL form. A candidate's
encoding is the smallest alphabet of ``ALPHABETS`` that has all its characters; encoding and length class make its stratum. The null
hypothesis is ordinary writing, as the corpus's own candidates of the stratum show it:

* chi-squared uniformity of the alphabet: the unevenness (the statistic beyond its degrees of freedom, a character) on a log scale. Half of
  all random tokens are below that of an even draw, so twice their share is what the stratum has of these; the quantiles of the rest give centre and
  spread under the null. The centre is at least that of the margin ``UNEVEN`` (``UNEVEN_WIDE`` for alphabets of more than ``WIDE`` characters).
* runs above and below the alphabet's middle (with a continuity correction, as a count that is just as expected is no proof), and lag-1 serial
  correlation: both are near to nought for independent characters. Their spread under the null is what the rest needs for the stratum's mean square,
  and is ``SPREAD`` at least.

What the rest shows is weighted against these margins as if ``PRIOR`` more candidates had shown them. Each test gives a standard
normal score under the null, and the weighted sum of the three (``WEIGHTS``) a p-value that falls as a token of even, independent characters gets longer.
False discoveries are controlled at ``RATE`` by Benjamini and Hochberg's procedure within each stratum over all
candidates of the corpus, so short tokens are held to what short ordinary tokens look like. The procedure works on counts of
p-values in bins (an upper bound of each), so what is gathered is a few rows for any corpus. A random token inside a span of a
fixed pattern is not added again; one that goes beyond it is.

Positions are code points, ends exclusive. Defined cases: a null text is empty; an empty text has no spans, its digest is that of an empty string;
rows repeated in full are rows like others and count in the corpus's statistics; an empty table gives no rows; texts of any length are
scanned whole; further columns are kept by ``scan`` and ignored by the digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

# Fixed patterns; the least length is of the group named, counted after matching. Runs that must have a least
# length are matched with it: a greedy run's matches are the same.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "hex-upper": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36-upper": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64-url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
UNEVEN = 0.7
#: Calibrated on names and paths of 32 characters and more in source code.
UNEVEN_WIDE = 1.5
WIDE = 36
#: Least spread of the log of unevenness, and of the scores of runs and serial correlation, under the null hypothesis.
EVEN_SPREAD, SPREAD = 0.12, 1.3
PRIOR = 20
LEVELS = [k / 40 for k in range(1, 40)]
#: Squares of runs and serial correlation count up to here.
MOST_SQUARE = 25.0
WEIGHTS = (3.0, 1.0, 1.0)
RATE = 0.05
BIN = 20  # bins for each power of ten of a p-value
MOST_BIN = 400
CHUNK = 256


def _struct(start: Column, end: Column, match: Column, group: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), match.alias("match"), group.alias("group"))


NO_SPANS = "array<struct<start:int,end:int,match:string,group:string>>"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end, match and group of every match, leftmost and without overlaps.

    The text between matches and the matches give the places by running sums, kept in chunks so that many matches cost no square.
    """
    p = F.lit(pattern)
    once = F.array(F.struct(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, p, F.lit(0)).alias("b"), F.regexp_extract_all(text, p, F.lit(group)).alias("c")))

    def zipped(z: Column) -> Column:
        pairs = F.zip_with(F.slice(z["a"], F.lit(1), F.size(z["b"])), z["b"], lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len"), b.alias("match")))
        return F.zip_with(pairs, z["c"], lambda x, c: F.struct(x["gap"], x["len"], x["match"], c.alias("group")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(_struct(start, start + x["len"], x["match"], x["group"]))).alias("out"))

    def chunk(acc: Column, rows: Column) -> Column:
        one = F.aggregate(rows, F.struct(acc["at"].alias("at"), F.array().cast(NO_SPANS).alias("out")), step)
        return F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))

    def walk(rows: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK)), lambda i: F.slice(rows, i, F.lit(CHUNK)))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("out")), chunk)["out"])

    # Arrays of one element: what they are made of is worked out once.
    walked = F.flatten(F.transform(F.transform(once, zipped), walk))
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(NO_SPANS))


def _tails(z: Column) -> Column:
    """P(N(0, 1) <= z) of each of an array, within 2e-7."""

    def first(v: Column) -> Column:
        return F.struct(v.alias("z"), (1 / (1 + F.abs(v) * (0.3275911 / math.sqrt(2)))).alias("t"))

    def second(y: Column) -> Column:
        t = y["t"]
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.struct(y["z"], (poly * F.exp(y["z"] * y["z"] / -2) / 2).alias("p"))

    return F.transform(F.transform(F.transform(z, first), second), lambda y: F.when(y["z"] < 0, y["p"]).otherwise(1 - y["p"]))


def battery(tokens: Column) -> Column:
    """For an array of tokens, the stratum (encoding and length class) of each, its letters, and what the three tests measure.

    Each step is an array made from the one before, so no value is worked out twice.
    """
    letters = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])

    def encoded(t: Column) -> Column:
        e = F.lit("mixed")
        for name, alphabet in reversed(list(ALPHABETS.items())[:-1]):
            e = F.when(t.rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), F.lit(name)).otherwise(e)
        return F.struct(t.alias("t"), e.alias("e"))

    def placed(x: Column) -> Column:
        return F.struct(x["t"], x["e"], F.element_at(letters, x["e"]).alias("a"))

    def valued(x: Column) -> Column:
        values = F.transform(F.split(x["t"], ""), lambda c: F.call_function("instr", x["a"], c) - 1)
        squares = F.aggregate(F.split(x["a"], ""), F.lit(0.0), lambda s, c: s + F.pow(F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0)))
        return F.struct(x["e"], F.length(x["t"]).cast("double").alias("n"), F.length(x["a"]).cast("double").alias("k"), squares.alias("squares"), values.alias("v"))

    def walked(x: Column) -> Column:
        start = F.struct(F.lit(-1).alias("was"), F.lit(0).alias("changes"), F.lit(0).alias("high"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"))

        def step(s: Column, v: Column) -> Column:
            now, was = v * 2 >= x["k"], s["was"] * 2 >= x["k"]
            return F.struct(
                v.alias("was"),
                (s["changes"] + F.when((s["was"] >= 0) & (now != was), 1).otherwise(0)).alias("changes"),
                (s["high"] + now.cast("int")).alias("high"),
                (s["x"] + v).alias("x"),
                (s["xx"] + v * v).alias("xx"),
                (s["xy"] + F.when(s["was"] >= 0, s["was"] * v).otherwise(0)).alias("xy"),
            )

        return F.struct(x["e"], x["n"], x["k"], x["squares"], F.aggregate(x["v"], start, step).alias("w"))

    def measured(x: Column) -> Column:
        n, w = x["n"], x["w"]
        return F.struct(
            x["e"], n, x["k"], w["changes"], (x["k"] / n * x["squares"] - n).alias("chi"), (w["high"] * 2 * (n - w["high"]) / n).alias("runs"),
            (w["xx"] - w["x"] * w["x"] / n).alias("variance"), (w["xy"] - w["x"] * w["x"] / n).alias("covariance"), F.floor(F.log2(n) * 2).alias("class"),
        )

    def scaled(x: Column) -> Column:
        n, root = x["n"], F.sqrt(x["n"])
        spread = x["runs"] * (x["runs"] - 1) / (n - 1)
        runs = F.when(spread > 0, (F.abs(x["changes"] - x["runs"]) + 0.5) / F.sqrt(spread)).otherwise(root)
        serial = F.when(x["variance"] > 0, F.abs(x["covariance"] / x["variance"] * root + 1 / root)).otherwise(root)
        uneven = (x["chi"] - x["k"] + 1) / n
        stratum = F.concat_ws(":", x["e"], x["class"].cast("string"))
        return F.struct(stratum.alias("stratum"), x["k"], F.log(uneven + _shift(x["k"], x["class"])).alias("even"), runs.alias("runs"), serial.alias("serial"), x["class"])

    out = F.transform(tokens, lambda t: F.rtrim(t, F.lit("=")))
    for step in (encoded, placed, valued, walked, measured, scaled):
        out = F.transform(out, step)
    return out


def _shift(k: Column, length_class: Column) -> Column:
    """What makes any unevenness of a token of the class positive."""
    return 1.000001 + (k - 1) / F.pow(F.lit(2.0), length_class / 2)


def bins_of(measured: Column, null: Column) -> Column:
    """The p-value's bin of each of an array of ``battery``'s, under the null hypothesis of its stratum (center, spread, runs, serial)."""

    def near(x: Column, spread: Column) -> Column:
        # The cube root of a chi-squared value of one degree is nearly normal.
        return (F.pow(x / spread, F.lit(2 / 3)) - 7 / 9) / math.sqrt(2 / 9)

    def score(x: Column) -> Column:
        of = F.element_at(null, x["stratum"])
        a, b, c = WEIGHTS
        z = ((x["even"] - of["center"]) / of["spread"] * a + near(x["runs"], of["runs"]) * b + near(x["serial"], of["serial"]) * c) / math.sqrt(a * a + b * b + c * c)
        return F.greatest(F.lit(-8.0), z)

    def binned(p: Column) -> Column:
        b = F.floor(-F.log10(F.greatest(F.lit(1e-30), p)) * BIN).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(MOST_BIN), b))

    return F.transform(_tails(F.transform(measured, score)), binned)


def nulls(measured: DataFrame) -> list[dict]:
    """The null hypothesis of each stratum of tokens (stratum, k, class, even, runs, serial); some hundred strata at most."""
    below = (F.col("even") <= F.log(_shift(F.col("k"), F.col("class")))).cast("long")
    shown = measured.groupBy("stratum", "k", "class").agg(
        F.percentile_approx("even", LEVELS).alias("e"), F.avg(F.least(F.col("runs") * F.col("runs"), F.lit(MOST_SQUARE))).alias("r"),
        F.avg(F.least(F.col("serial") * F.col("serial"), F.lit(MOST_SQUARE))).alias("s"), F.count(F.lit(1)).alias("m"), F.sum(below).alias("below"),
    )
    return [null_of(**r.asDict()) for r in shown.collect()]


def null_of(stratum: str, k: float, e: list[float], r: float, s: float, m: int, below: int, **rest: float) -> dict:
    """Center and spread of ordinary tokens' log unevenness, spread of their runs and serial correlation, from what all tokens of a stratum show."""
    random = min(0.95, 2 * below / m)

    def quantile(u: float) -> float:
        return e[max(0, min(len(LEVELS) - 1, round((random + (1 - random) * u) * (len(LEVELS) + 1)) - 1))]

    def shrunk(found: float, margin: float) -> float:
        n = m * (1 - random)
        return max(margin, (found * n + margin * PRIOR) / (n + PRIOR))

    def spread_of(mean_square: float) -> float:
        return math.sqrt(max(0.0, (mean_square - random) / (1 - random)))

    margin = math.log((UNEVEN_WIDE if k > WIDE else UNEVEN) + 1.000001 + (k - 1) / 2 ** (rest["class"] / 2))
    # Of a normal distribution 0.8413 is one spread above its middle.
    center = quantile(0.5)
    return {"stratum": stratum, "center": shrunk(center, margin), "spread": shrunk(quantile(0.8413) - center, EVEN_SPREAD), "runs": shrunk(spread_of(r), SPREAD), "serial": shrunk(spread_of(s), SPREAD)}


def _map(rows: list, value) -> Column:
    """A map of strata; some hundred at most."""
    return F.create_map(*[x for r in rows for x in (F.lit(r["stratum"]), value(r))])


def _nulls_map(rows: list) -> Column:
    return _map(rows, lambda r: F.struct(*[F.lit(float(r[c])).alias(c) for c in ("center", "spread", "runs", "serial")]))


def discoveries(docs: DataFrame, rate: float = RATE) -> list:
    """For each stratum that has any discovery its null hypothesis and the least bin that is one; counts over all candidates of all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.filter(text.rlike(TOKEN)).select(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("t"))
    measured = written(tokens.select(F.explode_outer(battery(F.col("t"))).alias("b")).select("b.*"), "candidates")
    of = nulls(measured)
    if not of:
        return []
    bins = measured.select("stratum", bins_of(F.array(F.struct("stratum", "even", "runs", "serial")), _nulls_map(of))[0].alias("bin"))
    bins = bins.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("c"))
    all_of, up = W.partitionBy("stratum"), W.partitionBy("stratum").orderBy(F.desc("bin"))
    bins = bins.withColumn("m", F.sum("c").over(all_of)).withColumn("below", F.sum("c").over(up.rowsBetween(W.unboundedPreceding, 0)))
    held = bins.filter(F.pow(F.lit(10.0), -F.col("bin") / BIN) <= rate * F.col("below") / F.col("m"))
    least = {r["stratum"]: r["b"] for r in held.groupBy("stratum").agg(F.min("bin").alias("b")).collect()}
    return [r | {"least": least[r["stratum"]]} for r in of if r["stratum"] in least]


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with ``base`` and ``all_spans``: arrays of struct(start, kind's number, end), sorted."""
    least = discoveries(docs, rate)
    text = F.coalesce(F.col("text"), F.lit(""))

    def mark(found: Column, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    assign = F.filter(spans(text, ASSIGN, 2), lambda s: F.length(s["group"]) >= ASSIGN_LEAST)
    out = docs.withColumn("_base", F.array_sort(F.concat(mark(assign, "assign"), mark(spans(text, ACCESS), "access"), mark(spans(text, HEX), "hex"))))
    if not least:
        return out.withColumn("_all", F.col("_base"))
    out = out.withColumn("_tokens", spans(text, TOKEN))
    known = F.array(*[F.lit(r["stratum"]) for r in least])
    # Tokens of strata without a discovery are dropped before they are scored.
    pairs = F.zip_with("_tokens", battery(F.transform("_tokens", lambda s: s["match"])), lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    out = out.withColumn("_tokens", F.filter(pairs, lambda x: F.array_contains(known, x["m"]["stratum"])))
    out = out.withColumn("_bins", bins_of(F.transform("_tokens", lambda x: x["m"]), _nulls_map(least)))
    bins = _map(least, lambda r: F.lit(r["least"]))
    chosen = F.filter(
        F.zip_with(
            "_tokens",
            "_bins",
            lambda x, b: F.struct(x["s"]["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["s"]["end"].alias("end"), (b >= F.element_at(bins, x["m"]["stratum"])).alias("random")),
        ),
        lambda s: F.coalesce(s["random"], F.lit(False)) & ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    chosen = F.transform(chosen, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return out.withColumn("_all", F.array_sort(F.concat("_base", chosen))).drop("_tokens", "_bins")


def listed(found: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def count(kind: str) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_all").alias("spans"), count("random")
    )


def redacted(docs: DataFrame, by: str = "[redacted]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``by``, overlapping spans as one, and n_chars, if there, following."""
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(between))).otherwise(acc["out"]).alias("out")
        )

    walked = F.aggregate("_all", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    whole = F.concat(F.array_join(F.transform(walked["out"], lambda x: F.concat(x, F.lit(by))), ""), F.substring(text, walked["at"] + 1, F.length(text)))
    # The row travels as one struct, so none of its columns can clash with those of the scan.
    out = scan(docs.select(F.struct("*").alias("_row"), "text")).withColumn("_new", F.when(F.size("_all") > 0, whole).otherwise(F.col("text")))
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in names:
        row = row.withField("n_chars", F.when(F.size("_all") > 0, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars").cast("long")))
    return out.select(row.alias("_row")).select("_row.*")
