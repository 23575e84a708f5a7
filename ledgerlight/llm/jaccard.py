"""Documents similar by the Jaccard index of their word shingles, with Bayesian pruning of candidates.

1. Each document's distinct shingles of five words are hashed. Documents with the same shingles are one class of copies, kept in
   one representative: the smallest id.
2. Representatives are put into buckets by bands of MinHash values. Two documents whose similarity reaches the threshold share a
   bucket but for ``(1 - t**ROWS) ** BANDS`` of them (3e-6 at a similarity of exactly 0.8). Pairs that share a bucket are the candidates, and no others.
3. Where candidates meet. All members of a bucket are linked to its smallest key; the connected components of these links are clusters.
   A cluster of ``TILE`` members and ``TILE_SHINGLES`` shingles at most is one unit of work, to which each member goes once. A larger
   one, such as unrelated documents that chains of buckets have joined, is not compared as a whole: each of its buckets is a unit (buckets with the
   same members are one), in tiles of ``TILE`` x ``TILE`` pairs if it is larger itself.
4. Inside a unit MinHash values are compared a few at a time; a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold, under a uniform prior, is below ``TOLERANCE``. The pairs that stay are verified by their exact
   intersections, as products of sparse incidence matrices, and counted in the first band that they share only.
5. A unit gives each member's number of links and a spanning forest of its links, never the pairs; the
   connected components of the forests are the classes.

Rows moved: documents, their ``BANDS`` keys, forests, and each member's shingles once for its cluster or for each bucket (32 at most) of a cluster of over
``TILE`` members. Only a single bucket of over ``TILE`` members of one band moves more: its members once for each ``TILE`` of them, as
every pair of different texts in it is a link to be counted or to be ruled out.

Defined cases: a text of fewer than five words has one shingle, all its words; one without words is similar to none, a class of
its own; ids may repeat: each row counts, and all rows of one id and one text get the same result; a null id is
smaller than any other and stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import ship
from .common import small, written
from .words import mix, shingles

N = 5
#: The threshold as a fraction.
THRESHOLD = (4, 5)
BANDS, ROWS = 32, 5
STEP = 32
TOLERANCE = 1e-6
TILE = 2_048
#: Shingles of one side of a tile: 8 bytes each.
TILE_SHINGLES = 1 << 20
#: Pairs compared at once, and cells of an incidence matrix.
PAIRS, CELLS = 1 << 17, 1 << 22
#: Shingles from which on the units gathered so far are worked on.
TOGETHER = 1 << 17
NULL_ID = -(1 << 63)


@functools.lru_cache(1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the MinHash functions."""
    x = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)


def min_hashes(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The MinHash values of each non-empty set of shingles."""
    a, b = _family()
    first = (np.cumsum(counts) - counts)[counts > 0]
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), len(a)), np.uint32)
    if len(first):
        held = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(len(a)):
                np.multiply(x, a[k], out=held)
                np.add(held, b[k], out=held)
                np.bitwise_xor(held, held >> np.uint32(15), out=held)
                out[:, k] = np.minimum.reduceat(held, first)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band, the band's number among what is hashed."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), (len(sig), BANDS))
        for c in range(ROWS):
            out = mix(out + parts[:, :, c])
    return out


def set_keys(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits that name each set of shingles."""
    out = np.zeros((len(counts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(salt)), dtype=np.uint64)])
            ends = np.cumsum(counts)
            out[:, k] = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
    return out


@functools.lru_cache(8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number n of compared values, the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1); its tail above t is P(Binomial(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, BANDS * ROWS + 1):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD[0] / THRESHOLD[1]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two blocks of signatures that no step prunes; within one block, each pair once."""
    rows = max(1, PAIRS // max(1, len(b)))
    parts = [_surviving(a[at : at + rows], b, at if same else None, threshold) for at in range(0, len(a), rows)]
    return tuple(np.concatenate([p[k] + (at * rows if k == 0 else 0) for at, p in enumerate(parts)] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _surviving(a: np.ndarray, b: np.ndarray, at: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of some rows; ``at``: where they are in the other block, if it is the same."""
    least, n = least_matches(threshold), a.shape[1]
    matches = np.zeros((len(a), len(b)), np.int16)
    for k in range(min(STEP, n)):
        matches += a[:, k][:, None] == b[:, k][None, :]
    i, j = np.nonzero(matches >= least[min(STEP, n)])
    if at is not None:
        later = i + at < j
        i, j = i[later], j[later]
    m = matches[i, j].astype(np.int32)
    for k in range(STEP, n, STEP):
        m += (a[i, k : k + STEP] == b[j, k : k + STEP]).sum(1)
        keep = m >= least[min(k + STEP, n)]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def first_shared(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band of which both rows of each pair have the same values; ``BANDS`` if there is none."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS // 8):
        same = (sig[i[at : at + PAIRS // 8]] == sig[j[at : at + PAIRS // 8]]).reshape(-1, BANDS, ROWS).all(2)
        out[at : at + PAIRS // 8] = np.where(same.any(1), same.argmax(1), BANDS)
    return out


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which of the pairs i, j of sets reach the threshold, exactly."""
    if not len(i):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([i, j]))
    size = np.array([len(x) for x in sets], np.int64)
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[x] for x in used])
    row = np.repeat(np.arange(len(used)), size[used])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    wide = int((times > 1).sum())
    # Pair by pair, or (many pairs of few sets) by incidence matrices, some columns at a time: whichever is less work.
    if float((size[i] + size[j]).sum()) * 30 <= 2.0 * len(used) * len(used) * wide / 8 + 1e6:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total, step = np.zeros((len(used), len(used)), np.float32), max(1, CELLS // len(used))
        for at in range(0, wide, step):
            lo, hi = np.searchsorted(column, [at, at + step])
            m = np.zeros((len(used), min(step, wide - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            total += m @ m.T
        both = np.rint(total[place[i], place[j]]).astype(np.int64)
    return threshold[1] * both >= threshold[0] * (size[i] + size[j] - both)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, the two halves of the shingles' key (null without shingles) and the bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s, counts = shingles(part["text"].to_pylist(), N)
                keys, some = set_keys(s, counts), counts > 0
                bands = np.zeros((len(counts), BANDS), np.uint64)
                bands[some] = band_keys(min_hashes(s, counts))
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"],
                        "th": part["th"],
                        "k1": pa.array(_signed(keys[:, 0].copy()), pa.int64(), mask=~some),
                        "k2": pa.array(_signed(keys[:, 1].copy()), pa.int64(), mask=~some),
                        "n": pa.array(counts, pa.int64()),
                        "bands": pa.array([b.tobytes() if k else None for b, k in zip(bands, some, strict=True)], pa.binary()),
                    }
                )

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    return docs.select(ids, F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, k1 long, k2 long, n long, bands binary")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each of n members' smallest connected member, by the links i, j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _tiles(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows sorted by (unit, band, x, y) to links: key, rows linked, the key's root in the unit."""

    def work(units: list[list[dict]]) -> tuple[list, list, list]:
        """Some units; their signatures are made together."""
        units = [[own[k] for k in sorted(own)] for rows in units if len(own := {(r["own"], r["key"]): r for r in rows}) > 1]
        out: tuple[list, list, list] = ([], [], [])
        if units:
            sets = [np.frombuffer(r["s"], np.uint64) for rows in units for r in rows]
            sig, at = min_hashes(np.concatenate(sets), np.array([len(s) for s in sets], np.int64)), 0
            for rows in units:
                for c, more in zip(out, unit(rows, sets[at : at + len(rows)], sig[at : at + len(rows)]), strict=True):
                    c.extend(more)
                at += len(rows)
        return out

    def unit(rows: list[dict], sets: list[np.ndarray], sig: np.ndarray) -> tuple[list, list, list]:
        x, y, band = rows[0]["x"], rows[0]["y"], rows[0]["band"]
        times = np.array([r["times"] for r in rows], np.int64)
        if x == y:
            i, j = surviving(sig, sig, True, threshold[0] / threshold[1])
        else:
            cut = sum(r["own"] == x for r in rows)
            i, j = surviving(sig[:cut], sig[cut:], False, threshold[0] / threshold[1])
            j = j + cut
        # Of a cluster the pairs that share any band, of a bucket those that share none before its own.
        shared = first_shared(sig, i, j)
        mine = shared < BANDS if band < 0 else shared == band
        i, j = i[mine], j[mine]
        ok = verified(sets, i, j, threshold)
        i, j = i[ok], j[ok]
        links = np.bincount(i, times[j], len(rows)) + np.bincount(j, times[i], len(rows))
        # The smallest key of each tree is its root.
        order = np.argsort([r["key"] for r in rows], kind="stable")
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        root = _forest(len(rows), rank[i], rank[j])
        keys = [r["key"] for r in rows]
        return keys, links.astype(np.int64).tolist(), [keys[order[root[rank[k]]]] for k in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict]] = []
        now, size = None, 0

        def made() -> pa.RecordBatch:
            out = work(held)
            held.clear()
            return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("key", "links", "root"), out, strict=True)})

        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                for r in batch.slice(at, 1_000).to_pylist():
                    if (tile := (r["unit"], r["band"], r["x"], r["y"])) != now:
                        if size >= TOGETHER:
                            yield made()
                            size = 0
                        held.append([])
                        now = tile
                    held[-1].append(r)
                    size += len(r["s"]) // 8
        yield made()

    return members.mapInArrow(run, "key long, links long, root long")


def _on(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``left`` joined with the groups ``right`` of it. The key is turned, so that both sides are dealt anew by it and Spark can split a group of
    many rows, which it can't where a side is still dealt by the group's own aggregate.
    """
    turned = F.bitwise_not(column).alias("_turned")
    return left.select("*", turned).join(right.select(turned, *[c for c in right.columns if c != column]), "_turned").drop("_turned")


def _units(buckets: DataFrame, members: DataFrame, tile: int, tile_shingles: int) -> DataFrame:
    """For each member (root, key, n) its units: key, units (unit, band, tiles, own)."""

    def tiles(n: Column, shingled: Column) -> Column:
        return F.greatest(F.ceil(n / tile), F.ceil(shingled / tile_shingles)).cast("int")

    sizes = members.groupBy("root").agg(tiles(F.count(F.lit(1)), F.sum("n")).alias("tiles"))
    members = written(_on(members, sizes, "root").select("key", "root", "n", "tiles"), "members")
    of_clusters = members.filter("tiles = 1").select("key", F.col("root").alias("unit"), F.lit(-1).alias("band"), "tiles")

    # Buckets with the same members have the same number and sums of hashes; the first band stands for all.
    large = buckets.join(members.filter("tiles > 1").select("key", "n"), "key")
    salted = F.xxhash64(F.lit(3), "key").cast("decimal(38,0)")
    each = large.groupBy("unit", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(salted).alias("y")).filter("m > 1")
    each = each.groupBy("m", "s", "x", "y").agg(F.min(F.struct("band", "unit")).alias("b")).select("b.unit", tiles(F.col("m"), F.col("s")).alias("tiles"))
    of_buckets = _on(large.select("key", "unit", "band"), each, "unit").select("key", "unit", "band", "tiles")
    every = of_clusters.unionByName(of_buckets)
    every = every.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("tiles")).cast("int"))
    return every.groupBy("key").agg(F.collect_list(F.struct("unit", "band", "tiles", "own")).alias("units"))  # one, or BANDS at most


def similar(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest id of its class), n_links (other rows whose similarity reaches the threshold)."""
    ship(docs.sparkSession)
    sketch = written(_sketch(docs), "sketches")
    # A class of copies: its smallest id and that row's text, its rows, and one of the equal bands.
    reps = sketch.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    # One number for each class from here on.
    reps = written(reps.select("k1", "k2", F.col("r.doc_id").alias("rep"), "r.th", "times", "n", "bands", F.xxhash64("k1", "k2").alias("key")), "classes")

    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring(F.col("bands"), k * 8 + 1, F.lit(8))))
    buckets = reps.select("key", F.posexplode(each).alias("band", "unit"))
    heads = buckets.groupBy("unit").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("unit", "b")
    edges = _on(buckets.select("key", "unit"), heads, "unit").filter("key <> b").select(F.col("key").alias("a"), "b")
    clusters = components(edges)

    members = written(clusters.join(reps.select("key", "n"), F.col("node") == F.col("key")).select("root", "key", "n"), "members")
    units = _units(buckets, members, tile, tile_shingles)
    units = written(reps.select("key", "k1", "k2", "rep", "th", "times").join(units, "key"), "units")

    links = written(_tiles(_with_shingles(docs, units), threshold), "links")
    found = links.groupBy("key").agg(F.sum("links").alias("others"))
    trees = components(links.filter("key > root").select(F.col("key").alias("a"), F.col("root").alias("b")))

    named = reps.select("k1", "k2", "key", "rep", "times").join(trees, F.col("key") == F.col("node"), "left").join(found, "key", "left")
    named = named.withColumn("tree", F.coalesce("root", "key")).select("tree", "k1", "k2", "rep", "times", "others")
    least = named.groupBy("tree").agg(F.min("rep").alias("class_id"))
    named = _on(named, least, "tree").select("k1", "k2", "class_id", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"))

    rows = sketch.select("doc_id", "k1", "k2").join(named, ["k1", "k2"], "left")

    def known(c: str) -> Column:
        return F.when(F.col(c) != NULL_ID, F.col(c))

    rows = rows.withColumn("class_id", F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return rows.select(
        known("doc_id").alias("doc_id"), known("class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _with_shingles(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Each member's shingles, once for every tile that it is in, sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of one id and text are one member
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                new = [k for k, key in enumerate(part["key"].to_pylist()) if not (key in seen or seen.add(key))]
                part = part.take(pa.array(new, pa.int64()))
                s, counts = shingles(part["text"].to_pylist(), N)
                keys = set_keys(s, counts)
                right = (_signed(keys[:, 0].copy()) == part["k1"].to_numpy()) & (_signed(keys[:, 1].copy()) == part["k2"].to_numpy())
                ends = np.cumsum(counts)
                made = [s[e - c : e].tobytes() if k else None for e, c, k in zip(ends, counts, right, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("key", "times", "units")), pa.array(made, pa.binary())], names=["key", "times", "units", "s"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rep")
    # By id and text: neither a null id nor a text that many rows share is met by more than its own class.
    texts = docs.select(ids, F.xxhash64("text").alias("th"), "text").join(small(units), ["rep", "th"])
    texts = texts.select("key", "times", "units", "k1", "k2", "text")
    unit = "array<struct<unit:long,band:int,tiles:int,own:int>>"
    rows = texts.mapInArrow(run, f"key long, times long, units {unit}, s binary").filter("s is not null")
    rows = rows.select("key", "times", "s", F.explode("units").alias("u")).select("key", "times", "s", "u.*")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("unit", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "times", "s")
    return rows.repartition("unit", "band", "x", "y").sortWithinPartitions("unit", "band", "x", "y")


#: The same classes by brute force: every pair that shares a shingle, and a recursive closure.
SIMILAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1),
l AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
