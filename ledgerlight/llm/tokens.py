"""Token ids by the tokenizers library, each distinct pre-token encoded once per Python worker.

The library encodes every pre-token on its own, so a text's ids are its pre-tokens' ids in turn. Texts of ASCII and Latin letters are
split here, many at once as arrays, by the two patterns below; pre-tokens are known by 128 bits of hash and looked up in a table of
fixed size that the library fills: what is missing is encoded once and put where it was missed. Runs of letters go to the library many in
one string, where the vocabulary marks which ids end (or begin) a pre-token. Any other text, one that may hold a
special token's string, and any vocabulary with another pattern go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pandas as pd

#: Places of each of the table's two ways, 24 bytes each, and ids that the table's entries may hold together before it starts anew.
PLACES, POOL = 1 << 19, 1 << 22
#: Characters split at once, and runs of letters that the library gets in one string.
CHUNK, TOGETHER = 1 << 18, 400
#: Fixed value: the pattern of byte-level pre-tokens. Runs take one space before them, other white space is a pre-token.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the pattern of word pre-tokens. White space is dropped, digits stand alone.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What an apostrophe is joined with.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Characters up to here have the same class and the same one-character lower case in any Unicode version, and are their
#: own normal form, but for those in ``ODD``.
LAST_PLAIN = 0x17F
ODD = (*range(0x1C, 0x20), 0x85, 0xAD, 0x130)
#: The steps of a normaliser that plain texts need only be lowered for: white space is dropped by its pattern.
LOWERING = ["NFC", "Replace", "Lowercase"]
#: Between texts; no plain text has it.
APART = "￿"

EDGE, LETTER, NUMBER, OTHER, SPACE, BLANK = range(6)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.int8)
    for c in range(LAST_PLAIN + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if chr(c) in "\t\n\x0b\x0c\r\xa0" else OTHER
    out[ord(" ")], out[ord(APART)] = SPACE, EDGE
    return out


@functools.lru_cache(1)
def _odd() -> str:
    return "".join(map(chr, ODD))


@functools.lru_cache(1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of two odd bases its powers and those of its inverse, modulo 2**64."""
    out = []
    with np.errstate(over="ignore"):
        for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
            out.append(tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + 1, np.uint64(b))]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))))
    return out


def split(u: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of code points (texts with ``APART`` between them and at the end) start and end.

    ``spaced`` for the byte-level pattern, else that of words.
    """
    kind = _classes()[u]
    group = np.where(kind == BLANK, np.int8(SPACE), kind)
    change = group[1:] != group[:-1]
    if not spaced:
        change |= group[1:] == NUMBER
    a = np.concatenate([[0], np.flatnonzero(change) + 1])
    b = np.concatenate([a[1:], [len(u)]])
    run = group[a]

    # An apostrophe alone before letters may join some of them.
    lone = np.flatnonzero((run[:-1] == OTHER) & (b[:-1] - a[:-1] == 1) & (u[a[:-1]] == ord("'")) & (run[1:] == LETTER))
    if spaced and len(lone):
        lone = lone[(a[lone] == 0) | (kind[a[lone] - 1] != SPACE)]
    if len(lone):
        x, size = u[b[lone]], b[lone + 1] - b[lone]
        y = u[np.minimum(b[lone] + 1, len(u) - 1)]
        joins = np.isin(x, [ord(c) for c in SHORT]).astype(np.int64)
        for first, second in LONG:
            joins[(x == ord(first)) & (y == ord(second)) & (size > 1)] = 2
        b[lone] += joins
        a[lone + 1] += joins

    first, last = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)  # a second piece of white space
    if spaced:
        blank = np.flatnonzero((run[:-1] == SPACE) & (run[1:] != EDGE))  # before what is no white space
        ends_in_space = kind[b[blank] - 1] == SPACE
        to_next, alone = blank[ends_in_space], blank[~ends_in_space]
        a[to_next + 1] -= 1
        first[alone], last[alone] = b[alone] - 1, b[alone]
        b[blank] -= 1
        keep = run != EDGE
    else:
        keep = (run != EDGE) & (run != SPACE)
    start, end = np.stack([a, first], 1), np.stack([b, last], 1)
    found = (end > start) & keep[:, None]
    return start[found], end[found]


class Encoder:
    """Encodes texts by one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]]) if n]
        pre = spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [pre])
        found = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split" and s["invert"] and s["behavior"] == "Removed"]
        found += [BYTE_LEVEL for s in steps if s.get("type") == "ByteLevel" and s["use_regex"] and not s["add_prefix_space"]]
        self.spaced = found == [BYTE_LEVEL] and not kinds
        self.known = self.spaced or found == [WORDS] and kinds == LOWERING
        self.special = [t["content"] for t in spec["added_tokens"]]
        # In runs of letters: whether an id begins a pre-token (by its space), or ends one.
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.marks[i] = token.startswith("Ġ") if self.spaced else token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        """An empty table: for each way and place both hashes, and where the ids are (first id * 2**16 + how many)."""
        self.keys, self.checks, self.refs = (np.zeros((2, PLACES), t) for t in (np.uint64, np.uint64, np.int64))
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def plain(self, text: str) -> bool:
        """Whether a text may be split here."""
        if not self.known or len(text) >= CHUNK or any(x in text for x in self.special):
            return False
        return (text.isascii() or max(text) <= chr(LAST_PLAIN)) and not any(c in text for c in _odd())

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of ``dtype``."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.plain(text):
                out[i] = self.whole(text)
                continue
            if size + len(text) >= CHUNK:
                self._encode(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(text) + 1
        if held:
            self._encode(texts, held, out)
        return out

    def _encode(self, texts: list[str | None], which: list[int], out: list[bytes]) -> None:
        joined = APART.join([*(texts[i] for i in which), ""])
        if not self.spaced:
            joined = joined.lower()
        u = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        start, end = split(u, self.spaced)
        with np.errstate(over="ignore"):
            keys = []
            for up, down in _powers():
                total = np.concatenate([[np.uint64(0)], np.cumsum((u + np.uint32(1)) * up[: len(u)], dtype=np.uint64)])
                keys.append((total[end] - total[start]) * down[start])
        refs = self._refs(joined, u, start, end, *keys)
        if refs is None:
            for i in which:
                out[i] = self.whole(texts[i])
            return
        each = refs & 0xFFFF
        ends = np.cumsum(each)
        at = np.repeat((refs >> 16) - (ends - each), each)
        at += np.arange(len(at))
        flat = self.pool[at].tobytes()
        texts_end = np.flatnonzero(u == ord(APART))
        stops = np.concatenate([[0], ends])[np.searchsorted(start, texts_end)] * self.dtype.itemsize
        a = 0
        for i, b in zip(which, stops.tolist(), strict=True):
            out[i], a = flat[a:b], b

    def _refs(self, joined: str, u: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, check: np.ndarray) -> np.ndarray | None:
        """Where the ids of each pre-token are; None where two pre-tokens have one hash, or one has more ids than an entry can hold."""
        with np.errstate(over="ignore"):
            place = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)
        refs = np.where((self.keys[0][place] == key) & (self.checks[0][place] == check), self.refs[0][place], -1)
        missed = np.flatnonzero(refs < 0)
        there = place[missed]
        second = (self.keys[1][there] == key[missed]) & (self.checks[1][there] == check[missed])
        refs[missed[second]] = self.refs[1][there[second]]
        missed = missed[~second]
        if not len(missed):
            return refs
        codes, distinct = pd.factorize(key[missed])
        sample = np.empty(len(distinct), np.int64)
        sample[codes[::-1]] = missed[::-1]
        if (check[sample][codes] != check[missed]).any():
            return None
        first, last = start[sample], end[sample]
        runs = (_classes()[u[last - 1]] == LETTER) & (u[first] == ord(" ") if self.spaced else u[first] != ord("'"))
        ids, lengths, order = self._library([joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], runs)
        if lengths.max() >= 1 << 16:
            return None
        if self.used + len(ids) > POOL:
            if self.used == 0:
                return None
            self._clear()
            return self._refs(joined, u, start, end, key, check)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        ends = self.used + np.cumsum(lengths[order])
        made = np.empty(len(order), np.int64)
        made[order] = (ends - lengths[order]) << 16 | lengths[order]
        self.used += len(ids)
        refs[missed] = made[codes]
        # The way that is free, else the one that a bit of the hash names.
        to, k = place[sample], key[sample]
        way = np.where(self.refs[0][to] == 0, 0, np.where(self.refs[1][to] == 0, 1, (k & np.uint64(1)).astype(np.int64)))
        self.keys[way, to], self.checks[way, to], self.refs[way, to] = k, check[sample], made
        return refs

    def _library(self, words: list[str], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pre-tokens, how many each has, and in which order they follow; ``runs``: which are runs of letters."""
        lengths = np.zeros(len(words), np.int64)

        def encoded(some: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

        which, apart = np.flatnonzero(runs), np.flatnonzero(~runs).tolist()
        groups = [which[k : k + TOGETHER] for k in range(0, len(which), TOGETHER)]
        order, flat = [], []
        joiner = "" if self.spaced else " "
        for some, ids in zip(groups, encoded([joiner.join([words[i] for i in g.tolist()]) for g in groups]), strict=True):
            at = np.flatnonzero(self.marks[ids])
            if len(at) == len(some):
                lengths[some] = np.diff(np.append(at, len(ids))) if self.spaced else np.diff(at, prepend=-1)
                order.append(some)
                flat.append(ids)
            else:  # a vocabulary that marks them in another way
                apart.extend(some.tolist())
        for i, ids in zip(apart, encoded([words[i] for i in apart]), strict=True):
            lengths[i] = len(ids)
            flat.append(ids)
        order.append(np.array(apart, np.int64))
        return np.concatenate(flat), lengths, np.concatenate(order)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)
