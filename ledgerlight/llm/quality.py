"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are shares of character classes, lengths, repetition of its words and of
the line in its document, and the same of the lines before and after it. Two-state forward-backward gives each line's marginal
probability of being good, and a document's score is the mean of its lines' marginals weighted by their lengths.

The field is trained by its conditional likelihood, in one task, on a bounded sample of labelled documents (``SAMPLE`` documents of
``SAMPLE_CHARS`` characters at most, the first in the order of a hash of the id), a document's label being that of all its lines. Held-out
documents never enter the sample. Scoring handles every whole text.

Defined cases: a null or empty text, or one of blank lines alone, is one empty line; several labels of a document count by their mean
(good from a half); null labels don't count; without labels every score is a half; null ids are not held out; rows
repeated in full are rows like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free
from .words import mix, word_hashes

SAMPLE = 3_000
SAMPLE_CHARS = 20_000
ROUNDS = 120
RATE = 0.1
PENALTY = 2e-3
THRESHOLD = 0.3
FOLDS = 5
CHARS = 1 << 19  # characters handled at once

CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other")
PLAIN = 0x3000


def _classes() -> np.ndarray:
    out = np.zeros(PLAIN + 1, np.int8)
    for c in range(PLAIN + 1):
        x, kind = chr(c), unicodedata.category(chr(c))
        name = "lower" if kind in ("Ll", "Lo", "Lm") else "upper" if kind in ("Lu", "Lt") else "digit" if kind[0] == "N" else "space" if kind[0] == "Z" or x in "\t\r\n" else "other"
        if x in ".,;:?'\"()-’“”«»¿¡":
            name = "stop"
        elif x in "!":
            name = "mark"
        elif kind[0] in "SP" and name == "other":
            name = "symbol"
        out[c] = CLASSES.index(name)
    return out


TABLE = _classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' lengths, and how many lines each text has."""
    lines, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = [x for x in (t or "").split("\n") if x.strip()] or [""]
        lines += own
        counts[i] = len(own)
    length = np.array([len(x) for x in lines], np.int64)
    u = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    kind = TABLE[np.minimum(u, PLAIN)]
    share = np.stack([np.add.reduceat((kind == k).astype(np.int32), start) for k in range(len(CLASSES))], 1).astype(np.float64)
    share[:, CLASSES.index("space")] -= 1  # the line feed
    share /= np.maximum(length, 1)[:, None]

    h, n = word_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), n)
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=len(lines)) if len(h) else np.zeros(len(lines))
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(lines))
    words = np.maximum(n, 1)

    document = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0)), dtype=np.uint64)])
    ends = np.cumsum(n)
    whole = sums[ends] - sums[ends - n]
    _, same, times = np.unique(np.stack([document.astype(np.uint64), whole], 1), axis=0, return_inverse=True, return_counts=True)
    times = times[same.reshape(-1)]
    repeated = (times > 1) & (n > 0)

    x = np.column_stack(
        [
            share,
            np.log1p(length) / 5,
            np.log1p(n) / 4,
            length / words / 10,
            again / words,
            distinct / words,
            (distinct / words) * np.log1p(n) / 4,
            repeated,
            np.log(times) * (n > 0),
            share[:, 1] > 0.3,
            share[:, 5] > 0.02,
            share[:, 6] > 0.02,
            share[:, 6] > 0.1,
            (n <= 2),
        ]
    ).astype(np.float64)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(lines), bool)
    last[np.cumsum(counts) - 1] = True
    before = np.where(first[:, None], 0, np.roll(x, 1, 0))
    after = np.where(last[:, None], 0, np.roll(x, -1, 0))
    return np.column_stack([np.ones(len(lines)), x, before, after, first, last]), length, counts


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by number of lines, the most first; the first line of each; how many have a t-th line."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), side="right")
    return order, begin, alive


def _softplus_ratio(f: np.ndarray, to1: np.ndarray, to0: np.ndarray) -> np.ndarray:
    """log((e^f e^to1[1] + e^to1[0]) / (e^f e^to0[1] + e^to0[0]))"""
    return np.logaddexp(f + to1[1], to1[0]) - np.logaddexp(f + to0[1], to0[0])


def marginals(s: np.ndarray, counts: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log odds of each line, and P(good); s are the lines' scores, a[j, k] the step from state j to k."""
    f, b = s.astype(np.float64).copy(), np.zeros(len(s))
    _, begin, alive = _steps(counts)
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        f[at] += _softplus_ratio(f[at - 1], a[:, 1], a[:, 0])
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        b[at - 1] = _softplus_ratio(s[at] + b[at], a[1], a[0])
    return f, b, 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))


def train(texts: list[str], good: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Weights by Adam on the penalised conditional log-likelihood; classes weigh alike."""
    x, _, counts = line_features(texts)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0, 1
    scale[0] = 1
    x = (x - mean) / scale
    y = np.repeat(good.astype(np.float64), counts)
    w, a = np.zeros(x.shape[1]), np.zeros((2, 2))
    document = np.repeat(np.arange(len(counts)), counts)
    inner = np.flatnonzero(document[1:] == document[:-1])  # lines with a next one
    mass = 1 / np.maximum(1, np.sqrt(counts))[document]  # long documents don't rule
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    for r in range(1, rounds + 1):
        s = x @ w
        f, b, p = marginals(s, counts, a)
        gw = x.T @ ((y - p) * mass) / mass.sum() - PENALTY * w
        ga = np.zeros((2, 2))
        if len(inner):
            nxt = s[inner + 1] + b[inner + 1]
            e = np.stack([np.zeros(len(inner)) + a[0, 0], a[0, 1] + nxt, a[1, 0] + f[inner], a[1, 1] + f[inner] + nxt])
            e = np.exp(e - e.max(0))
            e = e / e.sum(0) * mass[inner]
            total = mass[inner].sum()
            for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                seen = (mass[inner] * ((y[inner] == i) & (y[inner + 1] == j))).sum()
                ga[i, j] = (seen - e[k].sum()) / total - PENALTY * a[i, j]
        for g, m, v, z in ((gw, m1, v1, w), (ga, m2, v2, a)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            z += RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return {"w": w, "a": a, "mean": mean, "scale": scale}


def score(texts: list[str | None], model: dict) -> np.ndarray:
    """The score of each text: the length-weighted mean of its lines' P(good)."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < CHARS):
            size += len(texts[end] or "")
            end += 1
        x, length, counts = line_features(texts[at:end])
        _, _, p = marginals(((x - model["mean"]) / model["scale"]) @ model["w"], counts, model["a"])
        weight = np.maximum(length, 1)
        document = np.repeat(np.arange(end - at), counts)
        out[at:end] = np.bincount(document, p * weight) / np.bincount(document, weight)
        at = end
    return np.clip(out, 0, 1)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> dict | None:
    """A model from a bounded sample of the labelled documents that are not held out; None without any."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    marks = marks.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(marks), F.col("id") == F.col("doc_id"))  # at most ``sample`` rows
    texts = texts.filter(F.length("text") <= chars).orderBy(F.xxhash64("id"), "id", "text").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            made = train([r["text"] for r in rows], np.array([r["good"] for r in rows]))
            yield pa.record_batch({"model": pa.array([pickle.dumps(made)], pa.binary())})

    got = texts.select("text", "good").mapInArrow(run, "model binary").first()  # the limit leaves one partition
    return pickle.loads(got["model"]) if got else None


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int, 1 from ``threshold``), under longer names if it has such columns."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, sample, chars))
    names = docs.columns
    score_name, predicted_name = free("score", names), free("predicted", names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                texts = part[names.index("text")].to_pylist()
                got = score(texts, model.value) if model.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=[*names, score_name, predicted_name])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, `{score_name}` double, `{predicted_name}` int")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = classify(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
