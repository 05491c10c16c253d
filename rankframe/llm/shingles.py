"""Word shingles of Arrow text slices in numpy: 50-bit hashes per text, sorted, with their counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rankframe.llm.common import SHINGLE_WORDS

HASH_BITS = 50
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (nulls: none), and where each text begins and the last ends."""
    raw = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Places that cut ``data`` into pieces of about PIECE bytes without cutting a word."""
    cuts, n = [0], len(data)
    while n - cuts[-1] > PIECE:
        at = cuts[-1] + PIECE
        end = int(bounds[min(np.searchsorted(bounds, at), len(bounds) - 1)])
        while at < end:
            part = data[at:min(at + 4096, end)]
            blank = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(blank):
                end = at + int(blank[0])
            at += 4096
        cuts.append(max(end, cuts[-1] + 1))
    return [*cuts, n] if cuts[-1] < n else cuts


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, where each begins and ends, and at which word each text begins (and the last ends).

    Words are runs of bytes other than blank and 0x09 to 0x0D; ``fold`` takes A-Z as a-z.  Bytes are
    worked on piece by piece, so that the memory besides the results has a bound (but for longer words).
    """
    cuts, hashed, first, last = _pieces(data, bounds), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = data[a:b]
        inside = (part != 32) & ((part < 9) | (part > 13))
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = bounds[np.searchsorted(bounds, a, "right"):np.searchsorted(bounds, b)] - a
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _powers(len(part) + 1)
        value = part.astype(np.uint64)
        if fold:
            value += np.uint64(32) * ((part >= 65) & (part <= 90))
        value += np.uint64(1)
        value *= up[:len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        hashed.append(mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)))
        first.append(lo + a)
        last.append(hi + a)
    starts = np.concatenate(first)
    return np.concatenate(hashed), starts, np.concatenate(last), np.searchsorted(starts, bounds)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of every text's distinct shingles, by text and then hash.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    hashed, _, _, at = words(*text_bytes(texts))
    size = np.diff(at)
    per = np.where(size >= SHINGLE_WORDS, size - SHINGLE_WORDS + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), per)
    start = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + at[:-1][text]
    end, total = at[1:][text], np.zeros(len(text), np.uint64)
    padded = np.concatenate([hashed, np.zeros(SHINGLE_WORDS, np.uint64)])
    for j in range(SHINGLE_WORDS):
        total = total * np.uint64(_BASE) + np.where(start + j < end, padded[start + j], np.uint64(0))
    key = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix64(total) >> np.uint64(64 - HASH_BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(key)))
    key = key[where]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count
