"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification. DataFrame functions only.

A window of a document has as many words as a benchmark item. Its weighted shingles are its shingles of five words, each with the
weight of how often the window has it. A window holds an item when the weighted Jaccard index of their shingles
(sum of least weights over sum of greatest) is 0.8 or more.

1. Windows. A window as long as the item has at the threshold all but n/9 of its n shingles, in any order; a document shorter
   than the item, all but n/5. So either has one of any n/5 + 1 of them (its anchors). So a document's shingles are looked up among all items' anchors, and each hit names every window that
   holds it. Of these stay the windows that lack few enough of the item's distinct shingles to reach the threshold: a
   bound on bags of shingles, whatever their order, so no window that can reach it is lost.
2. Fingerprints. Each such window gets its 64-bit SimHash. The items' fingerprints are indexed in ``BLOCKS`` blocks of bits with all values at
   a distance of ``SLACK`` bits at most: two fingerprints within ``RADIUS = BLOCKS * (SLACK + 1) - 1`` bits agree
   with the index in one block at least, so no fingerprint of an item of that size within the radius is missed.
3. Candidates within the radius are verified by the exact index. The radius is 4.6 standard deviations above the expected distance
   of a pair at the threshold.

The sides made from the benchmark are broadcast while their counted rows are few, else joined by shuffles. A document's rows never meet
another's, so a passage that many documents share costs each of them the same.

Defined cases: words are runs of letters, digits and underscores in lower case; items of fewer than five words have one shingle, all their
words; items without words match nothing; a document shorter than an item is one window; null texts are empty; rows of
the same id are one document; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, small, written

N = 5
BITS = 64
BLOCKS, SLACK = 8, 2
RADIUS = BLOCKS * (SLACK + 1) - 1
THRESHOLD = (4, 5)
WORD = r"[\p{L}\p{N}_]+"

SCHEMA = "doc_id long, item_id long, similarity double, hamming int, start_word int, n_words int"


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: str, n: int) -> Column:
    """The hashes of all runs of ``n`` words in the column ``words``; none if it has fewer."""
    w = F.col(words)
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingled: str) -> Column:
    """Each bit is what most shingles have there, counted as often as they occur."""
    s = F.col(shingled)
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))

    def ones(b: Column) -> Column:
        return F.aggregate(s, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int"))

    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.when(ones(b) * 2 > F.size(s), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))


def block(fingerprint: Column, k: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def weighted_jaccard(a: str, b: str) -> tuple[Column, Column]:
    """Sums of the least and of the greatest weights of two columns of shingles."""
    x, y = F.col(a), F.col(b)

    def count(s: Column, h: Column) -> Column:
        return F.size(F.filter(s, lambda z: z == h))

    common = F.array_intersect(x, y)
    once = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    least = F.when(once, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, h: s + F.least(count(x, h), count(y, h))))
    return least, F.size(x) + F.size(y) - least


def passages(docs: DataFrame, benchmark: DataFrame, threshold: tuple[int, int] = THRESHOLD, whole_rows: bool | None = None) -> DataFrame:
    """One row per document and item that it holds, with the most similar window: ``SCHEMA``.

    ``whole_rows``: whether documents meet the anchors with all their shingles; None: if the anchors are few enough to be broadcast. The result is the same.
    """
    num, den = threshold
    ids = F.col("doc_id").cast("long").alias("doc_id")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("len", F.size("w")).withColumn("n", F.least(F.lit(N), "len"))
    items = written(items, "items")
    widths = sorted(r["n"] for r in items.select("n").distinct().collect())  # N values at most
    out = None
    for n in widths:
        made = _of_width(docs.select(ids, word_hashes(F.col("text")).alias("w")), items.filter(F.col("n") == n), n, num, den, whole_rows)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _of_width(docs: DataFrame, items: DataFrame, n: int, num: int, den: int, whole_rows: bool | None) -> DataFrame:
    # Written once: the optimiser would else work out words anew wherever shingles or fingerprints are used.
    items = written(items.withColumn("s", shingles("w", n)).drop("w", "n"), "items")
    items = written(items.withColumn("fp", simhash("s")), "items")
    # A window of fewer shingles than the item's n holds nt of them at least; one of as many holds more, 2nt/(1+t).
    lack = F.expr(f"cast((size(s) * {den - num}L) div {den}L as int)")
    by_hash = F.array_sort(F.transform("s", lambda h, q: F.struct(F.xxhash64(F.lit(7), h).alias("o"), h.alias("h"), q.alias("q"))))
    items = items.withColumn("g", F.xxhash64("s"))
    anchors = items.select("g", "len", F.explode_outer(F.slice(by_hash, F.lit(1), lack + 1)).alias("a")).select("g", "len", F.col("a.h").alias("h")).distinct()
    few = fits(anchors) if whole_rows is None else whole_rows
    texts = items.select("g", "s").dropDuplicates(["g"]).withColumnRenamed("s", "mine")
    texts = small(texts)

    # Outer generators: for an inner one the optimiser adds a filter that works out its array a second time, and what it is made of many times.
    shingled = docs.withColumn("s", shingles("w", n)).withColumn("words", F.size("w")).drop("w")
    if few:  # a shingle's row holds its document by reference, and only hits leave the task
        hits = shingled.select("doc_id", "words", "s", F.posexplode_outer("s").alias("p", "h")).join(F.broadcast(anchors), "h")
    else:  # places alone are shuffled, and documents once
        shingled = shingled.withColumn("row", F.xxhash64("doc_id", "s"))
        places = shingled.select("row", "words", F.posexplode_outer("s").alias("p", "h")).join(anchors, "h").distinct()
        hits = places.join(shingled.select("row", "doc_id", "s"), "row")
    hits = hits.join(texts, "g")
    last = F.greatest(F.col("words") - F.col("len"), F.lit(0))
    starts = F.sequence(F.greatest(F.col("p") - F.col("len") + n, F.lit(0)), F.least(F.col("p"), last))
    windows = hits.select("doc_id", "len", "s", "mine", F.explode_outer(starts).alias("start"))
    windows = windows.select("doc_id", "len", "start", "mine", F.slice("s", F.col("start") + 1, F.col("len") - n + 1).alias("ws"))
    shared = F.size("mine") - F.size(F.array_except("mine", "ws"))  # at most, each repeat as if it were there
    windows = windows.filter(shared * (den + num) >= (F.size("mine") + F.size("ws")) * num)
    windows = windows.select("doc_id", "len", "start", "ws").distinct()

    # Columns that can't be null: for others the optimiser adds a filter that works them out a second time, and what they are made of many times.
    found = windows.withColumn("ws", F.coalesce("ws", F.array().cast("array<bigint>"))).withColumn("wfp", F.coalesce(simhash("ws"), F.lit(0).cast("long")))
    found = found.select("doc_id", "len", "start", "ws", "wfp", F.posexplode_outer(F.array(*[block(F.col("wfp"), k) for k in range(BLOCKS)])).alias("k", "v"))
    width = BITS // BLOCKS
    near = [sum(1 << b for b in some) for r in range(SLACK + 1) for some in combinations(range(width), r)]
    index = items.select("item_id", "len", "s", "fp", F.posexplode_outer(F.array(*[block(F.col("fp"), k) for k in range(BLOCKS)])).alias("k", "b"))
    keys = index.select(F.xxhash64("item_id", "s").alias("item"), "len", "k", F.explode_outer(F.transform(F.lit(near).cast("array<bigint>"), lambda x: x.bitwiseXOR(F.col("b")))).alias("v")).distinct()
    found = found.join(small(keys), ["len", "k", "v"]).drop("k", "v").dropDuplicates(["doc_id", "len", "start", "wfp", "ws", "item"])

    whole = items.select(F.xxhash64("item_id", "s").alias("item"), "item_id", "s", "fp").dropDuplicates(["item"])
    found = found.join(small(whole), "item")
    found = found.withColumn("hamming", F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))).cast("int")).filter(F.col("hamming") <= RADIUS)
    least, most = weighted_jaccard("ws", "s")
    found = found.withColumn("least", least).withColumn("most", most).filter(F.col("least") * den >= F.col("most") * num)
    found = found.withColumn("similarity", F.col("least") / F.col("most"))
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("p"), "len")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("m.similarity").alias("similarity"),
        (-F.col("m.h")).cast("int").alias("hamming"),
        (-F.col("m.p")).cast("int").alias("start_word"),
        F.col("m.len").cast("int").alias("n_words"),
    )


#: The same by brute force: every window of every document that shares a shingle with an item.
PASSAGES_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS len, least(5, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT item_id, len, n, unnest(list_transform(range(1, len - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS g FROM i),
h AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS g FROM d JOIN (SELECT DISTINCT n FROM i) ON len(w) >= n),
c AS (SELECT DISTINCT h.doc_id, g.item_id, g.len, g.n FROM h JOIN g ON g.g = h.g AND g.n = h.n),
s AS (SELECT c.*, d.w, unnest(range(0, greatest(len(d.w) - c.len, 0) + 1)) AS start FROM c JOIN d USING (doc_id)),
x AS (SELECT doc_id, item_id, len, n, start, w[start+1:start+len] AS w FROM s),
y AS (SELECT doc_id, item_id, len, start, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS g FROM x),
a AS (SELECT doc_id, item_id, len, start, g, count(*) AS c FROM y GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT doc_id, item_id, len, start, sum(least(a.c, b.c)) AS least FROM a JOIN b USING (item_id, g) GROUP BY ALL),
t AS (SELECT doc_id, item_id, start, count(*) AS n FROM y GROUP BY ALL),
u AS (SELECT item_id, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(least) AS DOUBLE) / CAST(arg_max(t.n + u.n - least, least) AS DOUBLE) AS similarity, CAST(max(len) AS INT) AS n_words
FROM m JOIN t USING (doc_id, item_id, start) JOIN u USING (item_id) WHERE 5 * least >= 4 * (t.n + u.n - least) GROUP BY doc_id, item_id
"""
