"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of letters, digits, marks and underscores in lower case; all else separates. A word's hash is a polynomial in its
code points modulo 2**64, finished by a mixer; a shingle's hash is one of its words' hashes. Equal words and
shingles have equal hashes on every machine.
"""

from __future__ import annotations

import functools
import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD1342543DE82EF95)
CHUNK = 1 << 19
WORD = re.compile(r"\w")


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * CHUNK, BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * CHUNK, inverse)]), dtype=np.uint64)
    return up, down


@functools.lru_cache(1)
def _is_word() -> np.ndarray:
    """For each code point, whether it is a word's."""
    return np.array([WORD.match(chr(c)) is not None if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)], bool)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in turn, and how many each text has."""
    hashes, owners = [], []
    at = 0
    while at < len(texts):  # by chunks of about CHUNK characters, a longer text in several
        some, size = [], 0
        begin = at
        while at < len(texts) and (not some or size + len(texts[at] or "") < CHUNK):
            some.append((texts[at] or "").lower())
            size += len(some[-1]) + 1
            at += 1
        for text, first in _pieces(some, begin):
            h, where = _hash(text)
            hashes.append(h)
            owners.append(first + where)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return h, np.bincount(o, minlength=len(texts)).astype(np.int64)


def _pieces(some: list[str], begin: int):
    """Texts joined by a line feed that is a separator and marks the next text; one very long text in pieces cut between words."""
    if len(some) > 1 or len(some[0]) <= CHUNK:
        yield [s.replace("\x00", " ") for s in some], begin
        return
    text, at = some[0].replace("\x00", " "), 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and WORD.match(text[end]) and end - at < 2 * CHUNK - 2:
            end += 1
        yield [text[at:end]], begin
        at = end


def _hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    u = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    up, down = _powers()
    inside = _is_word()[u]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        if len(u) < len(up):
            total = np.concatenate([[np.uint64(0)], np.cumsum((u + np.uint32(1)).astype(np.uint64) * up[: len(u)], dtype=np.uint64)])
            h = (total[end] - total[start]) * down[start]
        else:
            h = np.array([sum((int(c) + 1) * pow(int(BASE), k, 1 << 64) for k, c in enumerate(u[a:b])) & ((1 << 64) - 1) for a, b in zip(start, end, strict=True)], np.uint64)
    return mix(h), np.cumsum(u == 0)[start] if len(texts) > 1 else np.zeros(len(start), np.int64)


def shingles(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of n words of each text in ascending order, and how many each has.

    A text of fewer words, but one at least, has one shingle: all its words.
    """
    h, counts = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), made)
    begin = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(made.sum())
    width = np.minimum(counts, n)[owner]
    s = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            use = width > k
            if use.all():
                s = mix(s * STEP + h[begin + k])
            else:
                s[use] = mix(s[use] * STEP + h[begin[use] + k])
    at = 0
    for k in made.tolist():
        if k > 1:
            s[at : at + k].sort()
        at += k
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)
