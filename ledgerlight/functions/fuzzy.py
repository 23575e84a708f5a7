"""Similarity of names from 0 to 100: indel ratio of sorted words, and of word sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import C, _c


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of many pairs at once, as arrays of bits; strings of over 64 characters one by one."""
    n = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    out = np.zeros(len(a), np.int64)
    for i in np.flatnonzero(n > 64).tolist():
        out[i] = lcs(a[i], b[i])
    some = np.flatnonzero((n > 0) & (n <= 64))
    if not len(some):
        return out
    x, y = (np.array([z[i] for i in some.tolist()], "U64").view(np.uint32).reshape(-1, 64) for z in (a, b))
    row = np.full(len(some), np.uint64((1 << 64) - 1))
    with np.errstate(over="ignore"):
        for k in range(int(n[some].max())):
            here = y[:, k][:, None]
            hit = row & np.packbits((x == here) & (here != 0), axis=1, bitorder="little").view("<u8")[:, 0]
            row = (row + hit) | (row - hit)
    out[some] = np.bitwise_count(~row)
    return out


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: shared words against either whole set, and the two sets against each other; 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.divide(200.0 * lcs_many(a, b), total, out=np.full(len(a), 100.0), where=total > 0)


def sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_sort`` of many pairs at once."""
    return _ratios(*([" ".join(sorted(x.split())) for x in z] for z in (a, b)))


def set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set`` of many pairs at once. What both strings begin with, the shared words, is part of any longest subsequence."""
    out, where, common, left, right = np.zeros(len(a)), [], [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            continue
        both, one, two = x & y, x - y, y - x
        if both and (not one or not two):
            out[i] = 100.0
            continue
        where.append(i)
        common.append(len(" ".join(both)) + 1 if both else 0)
        left.append(" ".join(sorted(one)))
        right.append(" ".join(sorted(two)))
    if where:
        c, n, m = np.array(common), np.fromiter(map(len, left), np.int64), np.fromiter(map(len, right), np.int64)
        best = 200.0 * (c + lcs_many(left, right)) / (2 * c + n + m)
        alone = np.where(c > 0, 200.0 * (c - 1) / np.maximum(1, 2 * c - 1 + np.minimum(n, m)), 0.0)  # the shared words against the shorter side
        out[np.array(where)] = np.maximum(best, alone)
    return out


def _filled(a: pd.Series) -> list[str]:
    return a.fillna("").tolist()


@F.pandas_udf(T.DoubleType())
def _sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(sort_ratios(_filled(a), _filled(b)))


@F.pandas_udf(T.DoubleType())
def _set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(set_ratios(_filled(a), _filled(b)))


@F.pandas_udf(T.DoubleType())
def _name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = _filled(a), _filled(b)
    return pd.Series(np.maximum(sort_ratios(x, y), set_ratios(x, y)))


def token_sort_ratio(a: C, b: C) -> Column:
    return _sort_ratio(_c(a), _c(b))


def token_set_ratio(a: C, b: C) -> Column:
    return _set_ratio(_c(a), _c(b))


def name_ratio(a: C, b: C) -> Column:
    """The greater of both."""
    return _name_ratio(_c(a), _c(b))
