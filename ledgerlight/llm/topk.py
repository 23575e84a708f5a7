"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are cut into buckets of about equal length, longest first (``BUCKET`` vectors, fewer if they have many components).
2. Queries, in blocks of about ``BLOCK``, meet the longest bucket. The k + 1st best score there is a query's first threshold.
3. A block then meets a bucket only if some query's threshold, divided by both lengths, is a cosine of 1 at most; inside, each query for
   which it is above 1 is pruned. Of what is left the bucket is worked on in the way that an estimate from a sample finds cheaper: by length (only vectors
   long enough to reach the least threshold), or by coordinates: products over the first ``h`` coordinates, those in which the queries are
   largest, and for the rest the greatest that the local cosine leaves, the product of the remaining lengths (Cauchy and Schwarz);
   only pairs that can still reach the threshold get the other coordinates.
4. Every pair that is left has its exact product. A block and bucket give the k + 1 best of each query, and these meet by query.

Buckets and blocks are rows of tables: no query, vector or threshold reaches the driver. Queries are put into blocks with others whose thresholds ask
for about the same length, so that whole buckets can be left out. Vectors equal in every component are kept in their k + 1 smallest ids only: no
query can need more, so a vector that a third of the rows share costs no more than others.

Defined cases: components are floor(scale * x), the scale a power of two; vectors that are null or hold null or non-finite components take no
part, all others do, however large: products beyond 53 bits are worked out in whole numbers of any size and ranked by these, only the score that is
returned is held at the bounds of 64 bits; vectors meet only those with as many components; rows repeated in full are rows like others, each the
other's candidate; a null id is no query and comes last among equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ship
from .common import small, written

BLOCK = 4_096
BUCKET = 4_096
#: Components of a bucket's or block's vectors together, and pairs completed at once.
VALUES, PAIRS = 1 << 21, 1 << 17
#: Multiplications of whole matrices that take as long as one of a single pair.
APART = 8
#: Shares of the coordinates that products may stop at, and queries and vectors of the estimate.
STOPS, SAMPLE = (0.25, 0.5, 0.75, 0.875), 128
#: Parts of the table of buckets in which blocks meet it.
SALT = 16
NULL_ID = np.iinfo(np.int64).max
LONG = np.iinfo(np.int64)
#: Bytes of a whole number that no product of doubles exceeds, for ranking.
WIDE = 288

FOUND = "q long, query_id long, times long, vec_id long, score long, beyond binary, own boolean"


def quantised(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) / scale of each component, which is exact; null where the vector takes no part."""
    sound = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))

    def part(x: Column) -> Column:
        d = x.cast("double")
        return F.when(F.abs(d) >= float(1 << 52), d).otherwise(F.floor(d * scale).cast("double") / scale)

    return F.when(column.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(column, part))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """Python's integers for scale * x."""
    return np.array([[int(c) * scale if abs(c) >= 1 << 52 else int(c * scale) for c in row] for row in x.tolist()], object).reshape(x.shape)


def best(q: np.ndarray, score: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k best of their query."""
    order = np.lexsort((cand, -score, q))
    q = q[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[rank < k]


class Unit:
    """A block of queries with their thresholds, and a bucket of vectors, longest first."""

    def __init__(self, queries: np.ndarray, theta: np.ndarray, vectors: np.ndarray, ids: np.ndarray, scale: int):
        self.scale, self.ids = scale, ids
        self.raw_q, self.raw_v, self.theta = queries, vectors, theta
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1]) * float(scale) ** 2
            self.exact = bool(most < 1 << 53)  # doubles hold every sum of products
            self.q, self.v = queries * scale, vectors * scale
            self.q_norm, self.v_norm = np.sqrt((self.q**2).sum(1)), np.sqrt((self.v**2).sum(1))
        self.counts: Counter = Counter()

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and product of each query's k best that reach its threshold."""
        if not self.exact:
            return self._beyond(k)
        longest = self.v_norm.max(initial=0.0) * (1 + 1e-9)
        alive = np.flatnonzero(self.theta <= self.q_norm * longest)
        self.counts["pruned"] += len(self.q) - len(alive)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        need = np.divide(self.theta[alive], self.q_norm[alive] * (1 + 1e-9), out=np.full(len(alive), -np.inf), where=self.q_norm[alive] > 0)
        rows = int((self.v_norm >= need.min()).sum())
        focus = np.argsort(-(self.q[alive] ** 2).sum(0), kind="stable")
        stop = self._stop(alive, rows, focus)
        self.counts["length" if stop is None else "coordinates"] += 1
        self.counts["short"] += len(self.v) - rows
        out = []
        for at in range(0, len(alive), max(1, PAIRS * 16 // max(1, rows))):
            some = alive[at : at + max(1, PAIRS * 16 // max(1, rows))]
            q, v, s = self._products(some, rows, k) if stop is None else self._completed(some, rows, focus[:stop], focus[stop:])
            keep = best(q, s, self.ids[v], k)
            out.append((q[keep], v[keep], s[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _stop(self, alive: np.ndarray, rows: int, focus: np.ndarray) -> int | None:
        """After how many coordinates to stop; None if whole products of the vectors long enough are cheaper."""
        q = alive[:: max(1, len(alive) // SAMPLE)][:SAMPLE]
        v = np.arange(rows)[:: max(1, rows // SAMPLE)][:SAMPLE]
        d, cost, stop = len(focus), float(len(focus)), None
        for share in STOPS:
            h = int(d * share)
            if 0 < h < d and rows:
                kept = self._open(q, v, focus[:h], focus[h:])[0].mean()
                if (now := h + kept * (d - h) * APART) < cost:
                    cost, stop = now, h
        return stop

    def _open(self, q: np.ndarray, v: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can reach the threshold by the coordinates of ``head``, and their products over these."""
        part = self.q[np.ix_(q, head)] @ self.v[np.ix_(v, head)].T
        left = np.sqrt((self.q[np.ix_(q, tail)] ** 2).sum(1))[:, None] * np.sqrt((self.v[np.ix_(v, tail)] ** 2).sum(1))[None, :]
        return part + left * (1 + 1e-9) + 1e-6 >= self.theta[q][:, None], part

    def _products(self, some: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.q[some] @ self.v[:rows].T
        least = self.theta[some]
        if rows > k:
            least = np.maximum(least, np.partition(s, rows - k, axis=1)[:, rows - k])
        a, b = np.nonzero(s >= least[:, None])
        return some[a], b, s[a, b]

    def _completed(self, some: np.ndarray, rows: int, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        can, part = self._open(some, np.arange(rows), head, tail)
        a, b = np.nonzero(can)
        self.counts["cut short"] += can.size - len(a)
        s = part[a, b]
        q, v = self.q[np.ix_(some, tail)], self.v[:rows][:, tail]
        for at in range(0, len(a), PAIRS):
            s[at : at + PAIRS] += (q[a[at : at + PAIRS]] * v[b[at : at + PAIRS]]).sum(1)
        keep = s >= self.theta[some][a]
        return some[a[keep]], b[keep], s[keep]

    def _beyond(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products in whole numbers of any size."""
        v, found = whole(self.raw_v, self.scale), []
        for i, row in enumerate(whole(self.raw_q, self.scale)):
            s = (v * row).sum(1) if v.shape[1] else np.zeros(len(v), object)
            for j in sorted(range(len(v)), key=lambda j: (-s[j], self.ids[j]))[:k]:
                found.append((i, j, s[j]))
        q, j, s = zip(*found, strict=True) if found else ((), (), ())
        return np.array(q, np.int64), np.array(j, np.int64), np.array([*s, None], object)[:-1]


def scored(s: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Scores within 64 bits, and for those at or beyond the bounds bytes that rank them."""
    if s.dtype != object:
        return pa.array(s.astype(np.int64)), pa.nulls(len(s), pa.binary())
    held = [max(LONG.min, min(LONG.max, x)) for x in s.tolist()]
    shift = 1 << (8 * WIDE - 1)
    return pa.array(held, pa.int64()), pa.array([(x + shift).to_bytes(WIDE) if LONG.min >= x or x >= LONG.max else None for x in s.tolist()], pa.binary())


def _in_buckets(few: DataFrame, bucket: int) -> DataFrame:
    """Vectors with the number of their bucket, in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, size = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, d in enumerate(batch["d"].to_pylist()):
                if d != now or size >= max(1, min(bucket, VALUES // max(1, d))):
                    number, now, size = number + 1, d, 0
                size += 1
                out[i] = (part << 32) + number
            yield batch.append_column("bucket", pa.array(out))

    order = ["d", F.desc("length"), F.col("id").asc_nulls_last()]
    dealt = few.repartitionByRange(*order, F.xxhash64("v")).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, "id long, v array<double>, d int, length double, bucket long"), "buckets")


def _units(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int, scale: int) -> DataFrame:
    """``FOUND`` for the pairs (block, bucket)."""

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        asks = rows["q"].is_valid().to_numpy()
        if asks.all() or not asks.any():
            return None
        flat = rows["v"].combine_chunks().flatten().to_numpy()
        v = flat.reshape(len(rows), len(flat) // len(rows))
        longest_first = np.argsort(-rows["length"].to_numpy()[~asks], kind="stable")
        vectors, ids = v[~asks][longest_first], rows["id"].fill_null(int(NULL_ID)).to_numpy()[~asks][longest_first]
        mine, numbers, times = (rows[c].to_numpy()[asks].astype(np.int64) for c in ("id", "q", "times"))
        unit = Unit(v[asks], rows["theta"].to_numpy()[asks], vectors, ids, scale)
        q, j, s = unit.pairs(k + 1)
        if not len(q):
            return None
        own = ids[j] == mine[q]
        own[own] = (unit.raw_v[j[own]] == unit.raw_q[q[own]]).all(1)
        score, beyond = scored(s)
        return pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(mine[q]), pa.array(times[q]), pa.array(ids[j]), score, beyond, pa.array(own)], names=[c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch["bucket"].to_numpy(), batch["block"].to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    if (key := tuple(keys[lo].tolist())) != now:
                        if held and (made := work(held)):
                            yield made
                        now, held = key, []
                    held.append(batch.slice(lo, hi - lo))
        if held and (made := work(held)):
            yield made

    asked = queries.join(pairs, "block").select("bucket", "block", "q", F.col("query_id").alias("id"), "times", "theta", "v", F.lit(None).cast("double").alias("length"))
    none = F.lit(None).cast("long")
    held = vectors.join(pairs, "bucket").select("bucket", "block", none.alias("q"), "id", none.alias("times"), F.lit(None).cast("double").alias("theta"), "v", "length")
    rows = asked.unionByName(held).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInArrow(run, FOUND)


def _blocks(queries: DataFrame, block: int, by: list[str]) -> DataFrame:
    """``queries`` with a block's number: by ``by``, and parts of each of about ``block`` queries."""
    sizes = queries.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"{VALUES} div greatest(1, max(d))"))))).alias("parts"))
    out = queries.join(small(sizes), by)
    return out.withColumn("block", F.xxhash64(*by, F.pmod(F.xxhash64("q"), F.col("parts")))).drop("parts")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", F.desc("own"))
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def top_k(
    rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """The k highest products of each row that ``queries`` selects with every other row: query_id, rank, vec_id, score."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    ship(rows.sparkSession)
    is_query = F.coalesce(queries, F.lit(False)).alias("is_query")
    vecs = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query).filter("v is not null")

    # A vector's k + 1 smallest ids stand for all its copies.
    same = W.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    few = vecs.select("id", "v").withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    vectors = _in_buckets(few.select("id", "v", F.size("v").alias("d"), F.sqrt(squares).alias("length")), bucket)
    buckets = vectors.groupBy("bucket", "d").agg(F.max("length").alias("longest"))
    buckets = written(buckets, "bucket-lengths")
    first = buckets.groupBy("d").agg(F.max_by("bucket", F.struct("longest", -F.col("bucket"))).alias("bucket"))

    asked = vecs.filter("is_query and id is not null").groupBy(F.col("id").alias("query_id"), "v").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("d", F.size("v")).withColumn("length", F.sqrt(squares)).withColumn("q", F.monotonically_increasing_id())
    asked = written(asked.withColumn("theta", F.lit(float("-inf"))), "queries")
    start = _blocks(asked, block, ["d"])
    pairs = start.select("block", "d").distinct().join(first, "d").select("block", "bucket")
    found = written(_units(start, vectors, pairs, k, scale), "first-products")

    # A query's threshold; a score held at the lower bound is none. The length that it asks for, in classes of a quarter of a power of two.
    theta = _best(found, k + 1).filter(F.col("r") == k + 1).filter(F.col("score") > int(LONG.min)).select("q", F.col("score").cast("double").alias("theta"))
    asked = asked.drop("theta").join(theta, "q", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))) * (1 - 1e-15 * F.signum(F.coalesce("theta", F.lit(0.0)))))
    needs = F.when((F.col("theta") > 0) & (F.col("length") > 0), F.col("theta") / (F.col("length") * float(scale) ** 2 * (1 + 1e-9))).otherwise(0.0)
    asked = asked.withColumn("needs", needs).withColumn("class", F.when(F.col("needs") > 0, F.floor(F.log2("needs") * 4)))
    asked = written(_blocks(asked.withColumn("class", F.coalesce("class", F.lit(-(1 << 40)))), block, ["d", "class"]), "thresholds")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part")
    blocks = asked.groupBy("block", "d").agg(F.min("needs").alias("needs")).select("block", "d", "needs", parts)
    others = buckets.join(first.select("bucket"), "bucket", "left_anti").withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(SALT)).cast("int"))
    pairs = written(blocks.join(others, ["d", "part"]).filter(F.col("needs") <= F.col("longest")).select("block", "bucket"), "pairs")
    found = found.unionByName(_units(asked, vectors, pairs, k, scale))

    # One row of the query's own vector is the query itself; its copies are candidates.
    found = _best(found, k + 1).withColumn("self", F.min(F.when(F.col("own"), F.col("r"))).over(W.partitionBy("q")))
    found = found.filter(F.col("self").isNull() | (F.col("r") != F.col("self"))).withColumn("rank", F.col("r") - F.coalesce((F.col("self") < F.col("r")).cast("int"), F.lit(0))).filter(F.col("rank") <= k)
    found = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(NULL_ID), F.col("vec_id")).alias("vec_id"), "score")
