"""Packing into windows of a fixed number of tokens by deficit round-robin over one queue per source.

A queue holds its source's documents in the order of the token table, cut into packets of half a ``QUANTUM`` tokens at most; a shorter
document is one packet. Every round gives each queue credit for its target share of one token. A queue sends its next packet in
the round in which its credit reaches the packet's middle, so it is never more than half a packet ahead of its share or behind it;
that deficit is carried from round to round, and so across windows and partitions. Packets in the order of rounds, those of one round by
queue, are the stream that is cut into windows: every window but the last is full.

No round is played: a queue's credit is known at any time, so a packet's round follows from its place in its queue alone,
``ceil(middle / share)``. Places in queues and in the stream are running sums of counts in levels, and
the stream is put together in stretches of about ``STRETCH`` tokens, each a task's work; no task has more, whatever the sources.

Between any two places of the stream, so in any window, a queue of the share p among S that are not dry is off its
target by quantum/2 * (1 + p * (S - 2)) tokens at most (a packet of its own, and its share of the others' packets).

Targets: by default the corpus's own proportions, so that all queues end together. Given ones (``targets``: source to weight, None for a null source) are
scaled to 1 if they sum to more; sources without one share what is left in the corpus's proportions, or come last if nothing is left. When a
queue is dry the others go on by their shares.

Defined cases: a null or empty text is its end token alone; a null source is a queue of its own; rows repeated in
full are packed as often as they occur; targets of sources that have no rows count for nothing; an empty table gives no rows; further
columns are ignored. Documents of any length are cut between packets and where windows end; packets of one document that follow each other in one window are
one piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ship
from .common import before, small, written
from .tokens import encoder

WINDOW = 2048
QUANTUM = 512
STRETCH = 1 << 17
END_ID = 1

PACKETS = "doc long, doc_id long, queue string, part int, ahead long, start long, n long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def queue_name(source: str | None) -> str:
    return "-" if source is None else f"+{source}"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, packet: int = QUANTUM // 2) -> DataFrame:
    """The packets of each document's ids with ``end_id`` behind them, and how many tokens their queue has before them in their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, given, docs_before = encoder(path), TaskContext.get().partitionId(), {}, 0
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                ids = [x + end for x in enc.ids(rows["text"].to_pylist())]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
                first = np.empty(len(n), np.int64)
                for i, (q, k) in enumerate(zip(rows["queue"].to_pylist(), n.tolist(), strict=True)):
                    first[i] = given.get(q, 0)
                    given[q] = first[i] + k
                packets = -(-n // packet)
                row = np.repeat(np.arange(len(n)), packets)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(packets) - packets, packets)) * packet
                length = np.minimum(n[row] - start, packet)
                ends = np.concatenate([[0], np.cumsum(length)]) * size
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 40) + docs_before + row), rows["doc_id"].cast(pa.int64()).take(pa.array(row)), rows["queue"].take(pa.array(row)), pa.array(np.full(len(row), part, np.int32)),
                        pa.array(first[row] + start), pa.array(start), pa.array(length), pa.array(n[row]), data,
                    ],
                    names=[c.split()[0] for c in PACKETS.split(", ")],
                )
                docs_before += len(n)

    queue = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text").mapInArrow(run, PACKETS)


def shares(queues: DataFrame, targets: dict[str | None, float] | None) -> tuple[Column, Column]:
    """For queues (queue, of: all tokens of it) the round of ``middle``, and the tokens sent in all rounds up to ``round``."""
    total = int(queues.agg(F.sum("of")).first()[0] or 0)
    if any(not 0 <= w < math.inf for w in (targets or {}).values()):
        raise ValueError("targets must be finite and not negative")
    named = {queue_name(s): w for s, w in (targets or {}).items() if w}
    sizes = {r["queue"]: r["of"] for r in queues.filter(F.col("queue").isin(*named)).collect()} if named else {}  # as many rows as targets
    scale = max(1.0, sum(named.values()))
    named = {q: w / scale for q, w in named.items() if q in sizes}
    rest = total - sum(sizes.values())
    left = 1 - sum(named.values()) if named else 1.0
    left = left if left > 1e-9 else 0.0
    last = max((sizes[q] / w for q, w in named.items()), default=0.0) if not left else 0.0  # the named queues are dry
    of, middle, at = F.col("of").cast("double"), F.col("middle").cast("double"), F.col("round")
    due = F.ceil(middle * rest / (of * (left or 1.0)) + last)
    for q, w in named.items():
        due = F.when(F.col("queue") == q, F.ceil(middle / w)).otherwise(due)
    sent = F.least(F.greatest(at - last, F.lit(0.0)) * (left or 1.0), F.lit(float(rest)))
    for q, w in named.items():
        sent = sent + F.least(at * w, F.lit(float(sizes[q])))
    return due.cast("double"), sent


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, quantum: int = QUANTUM, targets: dict[str | None, float] | None = None, stretch: int = STRETCH
) -> DataFrame:
    """One row per piece of a document (``PIECES``, and its source); every id lies in exactly one piece.

    The packets are written once to the shared folder; places are worked out from their counts, and one shuffle brings them into order.
    """
    if not 2 <= quantum <= 2 * window:
        raise ValueError("quantum must be 2 at least, and two windows at most")
    ship(docs.sparkSession)
    packets = written(tokenize(docs, path, end_id, quantum // 2), "packets")
    counts = before(packets.groupBy("queue", "part").agg(F.sum("n").alias("m")), "part", ["queue"], "m").drop("m")
    counts = written(counts.withColumnRenamed("before", "first"), "queues")
    due, sent = shares(counts.select("queue", "of").distinct(), targets)
    rows = packets.join(small(counts), ["queue", "part"]).withColumn("x", F.col("first") + F.col("ahead"))
    rows = rows.withColumn("middle", F.col("x") + F.col("n") / 2).withColumn("round", due)
    rows = rows.withColumn("stretch", F.floor(sent / stretch)).select("stretch", "round", "queue", "x", "doc", "doc_id", "start", "n", "doc_tokens", "ids")
    begins = written(before(rows.groupBy("stretch").agg(F.sum("n").alias("m")), "stretch", [], "m", 3).select("stretch", "before"), "stretches")
    order = W.partitionBy("stretch").orderBy("round", "queue", "x")
    rows = rows.withColumn("inside", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    rows = rows.join(small(begins), "stretch").withColumn("position", F.col("before") + F.col("inside"))
    rows = rows.select("doc", "doc_id", "queue", "start", "n", "doc_tokens", "position", "ids")
    return rows.mapInArrow(lambda batches: pieces(batches, encoder(path).dtype, window), f"{PIECES}, source string")


def pieces(batches: Iterator[pa.RecordBatch], dtype: np.dtype, window: int) -> Iterator[pa.RecordBatch]:
    """Packets in the stream's order, with their positions, to pieces; what goes on from one batch to the next is one piece."""
    names, held = ("doc", "start", "n", "doc_tokens", "position"), None
    for batch in batches:
        for at in range(0, batch.num_rows, 4_000):
            held = batch.slice(at, 4_000) if held is None else pa.concat_batches([held, batch.slice(at, 4_000)])
            col = {c: held[c].to_numpy() for c in names}
            # All but the last document's last run of packets.
            goes_on = (col["doc"][1:] == col["doc"][:-1]) & (col["position"][1:] == col["position"][:-1] + col["n"][:-1]) & (col["start"][1:] == col["start"][:-1] + col["n"][:-1])
            breaks = np.flatnonzero(~goes_on)
            done = int(breaks[-1]) + 1 if len(breaks) else 0
            if done:
                yield _cut(held.slice(0, done), goes_on[: done - 1], dtype, window)
            held = held.slice(done)
    if held is not None and held.num_rows:
        col = {c: held[c].to_numpy() for c in names}
        goes_on = (col["doc"][1:] == col["doc"][:-1]) & (col["position"][1:] == col["position"][:-1] + col["n"][:-1])
        yield _cut(held, goes_on, dtype, window)


def _cut(rows: pa.RecordBatch, goes_on: np.ndarray, dtype: np.dtype, window: int) -> pa.RecordBatch:
    """Pieces of packets, of which some go on where the one before ends: cut where a run of them or a window ends."""
    col = {c: rows[c].to_numpy() for c in ("start", "n", "doc_tokens", "position")}
    ids = memoryview(np.frombuffer(b"".join(rows["ids"].to_pylist()), dtype).astype("<u4").tobytes())
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))  # the first packet of each run
    ends = np.cumsum(col["n"])
    flat = (ends - col["n"])[first]
    length = np.append(flat[1:], ends[-1]) - flat
    position = col["position"][first]
    k = (position + length - 1) // window - position // window + 1
    run = np.repeat(np.arange(len(first)), k)
    seq = (position // window)[run] + np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
    begin, end = np.maximum(position[run], seq * window), np.minimum((position + length)[run], (seq + 1) * window)
    at = flat[run] + begin - position[run]
    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + end - begin).tolist(), strict=True)]
    row = pa.array(first[run])
    sources = pa.array([q[1:] if q[0] == "+" else None for q in rows["queue"].take(row).to_pylist()], pa.string())
    made = [col["start"][first][run] + begin - position[run], end - begin, crc, col["doc_tokens"][first][run], seq, begin - seq * window]
    return pa.RecordBatch.from_arrays([rows["doc_id"].take(row), *(pa.array(c, pa.int64()) for c in made), sources], names=[*(x.split()[0] for x in PIECES.split(", ")), "source"])
