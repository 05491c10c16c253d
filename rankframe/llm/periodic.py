"""Periodic runs of words: block convolution finds them, exact extension gives their ends.

At dyadic scale L (periods L to 2L-1) a text is cut every L words.  Any run of three periods holds one
such block of L words and its copy one period on, so every run has a block that occurs without a
mismatch in its following window at the run's period.  The sum of squared differences between block
and window is ``sum b*b + sum w*w - 2 sum b*w``; the last term is a correlation by number-theoretic
transform modulo 65537, exact in integers.  Zero mismatches give zero modulo the prime, so none is
missed; the few others are told apart by the extension.  A distance found seeds an extension to both
sides, by binary search over hashes of word spans; a run found is held against the words themselves.

Blocks longer than half the largest transform are cut to that: a shorter block occurs wherever the
longer one does.  A text is worked on in the memory of one task: about 30 bytes a word besides the
text, transforms in chunks of fixed size.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import add_by_text

#: A run has at least so many words and so many periods; the blocks below rely on both.
MIN_LENGTH = 24
MIN_PERIODS = 3
#: Blocks of the smallest scales, which share one: periods 1 to 7, then 8 to 15.
LEAST_BLOCK = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

#: A Fermat prime with 3 as primitive root: transforms of every power of two up to 2**16.
PRIME, ROOT = 65537, 3
MOST_BLOCK = 1 << 15
#: Numbers transformed at a time.
CHUNK = 1 << 17
#: Moduli of the span hashes.
_HASH_PRIMES = (2**31 - 1, 2**31 - 19)
_DIRECT = 64


# ------------------------------------------------------------------ transform
def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, between -PRIME and 2 * PRIME; exact while ``x`` is below 2**52."""
    return x - PRIME * np.floor(x * (1.0 / PRIME))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.int64)
    done, step = 1, base % prime
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step % prime
        done, step = done + more, step * step % prime
    return out


class Transform:
    """Number-theoretic transforms of ``size`` numbers as products with two small matrices (rows x columns)."""

    def __init__(self, size: int):
        self.size = size
        self.rows = 1 if size <= _DIRECT else 1 << ((size.bit_length() - 1) // 2)
        self.columns = size // self.rows
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        self.tables = [self._of(root), self._of(pow(root, -1, PRIME))]

    def _of(self, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrix over the rows, twiddles, matrix over the columns."""
        powers = _powers(root, self.size, PRIME).astype(np.float64)
        down, across = np.arange(self.rows), np.arange(self.columns)
        return (powers[np.outer(down, down) * self.columns % self.size], powers[np.outer(down, across)],
                powers[np.outer(across, across) * self.rows % self.size])

    def forward(self, x: np.ndarray, negated: bool = False) -> np.ndarray:
        """Frequencies (negated: of the inverse root) of each row of ``x``, as count x rows x columns."""
        over_rows, twiddles, over_columns = self.tables[negated]
        y = x.reshape(-1, self.rows, self.columns)
        if self.rows > 1:
            y = _reduced(_reduced(np.matmul(over_rows, y)) * twiddles)
        return _reduced(y.reshape(-1, self.columns) @ over_columns).reshape(-1, self.rows, self.columns)

    def backward(self, y: np.ndarray) -> np.ndarray:
        """``size`` times the numbers that have these frequencies."""
        over_rows, twiddles, over_columns = self.tables[True]
        y = _reduced(y.reshape(-1, self.columns) @ over_columns).reshape(-1, self.rows, self.columns)
        if self.rows > 1:
            y = _reduced(np.matmul(over_rows, _reduced(y * twiddles)))
        return y.reshape(-1, self.size)


_transform = cache(Transform)


def zero_mismatches(values: np.ndarray, squares: np.ndarray, at: np.ndarray, lag: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) where the block at ``at`` meets its copy modulo the prime, at distances lag to lag + block - 1.

    ``values`` are numbers below the prime and go on for 2 * block past the last window; ``squares``
    are the running sums of their squares, beginning with 0.
    """
    ntt, span = _transform(2 * block), np.lib.stride_tricks.sliding_window_view(values, 2 * block)
    step, found = max(1, CHUNK // (2 * block)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(at), step):
        s, w = at[a:a + step], at[a:a + step] + lag[a:a + step]
        blocks = span[s].copy()
        blocks[:, block:] = 0
        cross = ntt.backward(_reduced(ntt.forward(blocks, True) * ntt.forward(span[w])))[:, :block].astype(np.int64)
        own = (squares[s + block] - squares[s])[:, None]
        ends = np.lib.stride_tricks.sliding_window_view(squares, 2 * block)[w]
        other = ends[:, block:2 * block] - ends[:, :block]
        row, d = np.nonzero(((own + other) % PRIME * ntt.size - 2 * cross) % PRIME == 0)
        found.append((row + a, d + lag[a + row]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# ------------------------------------------------------------------ extension
class Spans:
    """Equality of word spans by hashes modulo two primes, ``round`` choosing the bases."""

    def __init__(self, ids: np.ndarray, round: int):
        rng = np.random.default_rng([13, round])
        self.parts = []
        for prime in _HASH_PRIMES:
            powers = _powers(int(rng.integers(1 << 20, prime - 1)), len(ids) + 1, prime).astype(np.uint32)
            sums = np.zeros(len(ids) + 1, np.uint32)
            total = 0
            for a in range(0, len(ids), CHUNK):
                part = (ids[a:a + CHUNK].astype(np.int64) * 2654435761 % prime + 1) * powers[a:min(a + CHUNK, len(ids))] % prime
                part = (np.cumsum(part) + total) % prime
                sums[a + 1:a + 1 + len(part)], total = part, int(part[-1])
            self.parts.append((prime, powers, sums))

    def equal(self, x: np.ndarray, d: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the ``n`` words from x equal those from x + d."""
        same = np.ones(len(x), bool)
        for prime, powers, sums in self.parts:
            here = sums[x + n].astype(np.int64) - sums[x]
            there = sums[x + d + n].astype(np.int64) - sums[x + d]
            same &= (here % prime * powers[d] - there) % prime == 0
        return same

    def reach(self, x: np.ndarray, d: np.ndarray, room: np.ndarray, onward: bool) -> np.ndarray:
        """How many words from x on (or before x) equal those d later, ``room`` at most."""
        n = np.zeros(len(x), np.int64)
        for bit in reversed(range(int(room.max(initial=0)).bit_length())):
            more = n + (1 << bit)
            can = np.flatnonzero(more <= room)
            begin = x[can] + n[can] if onward else x[can] - more[can]
            n[can[self.equal(begin, d[can], 1 << bit)]] += 1 << bit
        return n


def _scales(longest: int):
    """(lowest period, block) of each scale."""
    low = 1
    while MIN_PERIODS * low <= longest:
        yield low, min(max(low, LEAST_BLOCK), MOST_BLOCK)
        low = LEAST_BLOCK if low == 1 else 2 * low


def _blocks(begins: np.ndarray, ends: np.ndarray, low: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, block's place, first distance) of all pieces of windows at a scale."""
    stride, room = max(low, block) if low < MOST_BLOCK else low, ends - begins - block - low
    able = np.flatnonzero((room >= 0) & (ends - begins >= max(MIN_LENGTH, MIN_PERIODS * low)))
    per = room[able] // stride + 1
    text = np.repeat(able, per)
    at = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride
    pieces = max(1, low // block)
    text, at, lag = np.repeat(text, pieces), np.repeat(at, pieces), np.tile((low if low >= LEAST_BLOCK else 0) + np.arange(pieces) * block, len(at))
    inside = at + np.maximum(lag, 1) + block <= ends[text]
    return text[inside], at[inside], lag[inside]


def runs_of(ids: np.ndarray, bounds: np.ndarray, round: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``ids`` number the words of all texts (equal numbers, equal words); text t has those from
    bounds[t] to bounds[t + 1].  Starts count from the text's first word.
    """
    begins, ends = bounds[:-1], bounds[1:]
    longest = int((ends - begins).max(initial=0))
    none = np.zeros(0, np.int64)
    if longest < MIN_LENGTH:
        return none, none, none, none
    pad = 4 * min(MOST_BLOCK, max(LEAST_BLOCK, longest))
    residue = np.random.default_rng(round).integers(0, PRIME, int(ids.max()) + 1)
    values = np.concatenate([residue[ids], np.zeros(pad, np.int64)])
    squares = np.concatenate([[0], np.cumsum(values * values)])
    values, spans, found = values.astype(np.float64), None, [(none, none, none, none)]
    for low, block in _scales(longest):
        text, at, lag = _blocks(begins, ends, low, block)
        row, d = zero_mismatches(values, squares, at, lag, block)
        text, at = text[row], at[row]
        fits = (d > 0) & (at + d + block <= ends[text])
        text, at, d = text[fits], at[fits], d[fits]
        if not len(at):
            continue
        spans = spans or Spans(ids, round)
        real = spans.equal(at, d, block)
        text, at, d = text[real], at[real], d[real]
        if block >= low and len(at):  # blocks lie end to end: the first of those that match at one distance will do
            key = np.argsort(d * (len(ids) + 1) + at, kind="stable")
            text, at, d = text[key], at[key], d[key]
            goes_on = np.zeros(len(at), bool)
            goes_on[1:] = (at[1:] == at[:-1] + block) & (d[1:] == d[:-1]) & (text[1:] == text[:-1])
            text, at, d = text[~goes_on], at[~goes_on], d[~goes_on]
        for a in range(0, len(at), CHUNK):
            t, s, q = text[a:a + CHUNK], at[a:a + CHUNK], d[a:a + CHUNK]
            first = s - spans.reach(s, q, s - begins[t], False)
            last = s + q + spans.reach(s, q, ends[t] - s - q, True)
            long = last - first >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
            found.append((t[long], first[long], last[long], q[long]))
    text, first, last, q = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.lexsort((q, last, first))
    text, first, last, q = text[order], first[order], last[order], q[order]
    least = np.ones(len(q), bool)  # of one stretch's periods the smallest
    least[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    text, first, last, q = text[least], first[least], last[least], q[least]
    for t, a, b, p in zip(text, first, last, q):
        if not np.array_equal(ids[a:b - p], ids[a + p:b]):
            return runs_of(ids, bounds, round + 1)  # two spans with the same hashes: again with other ones
    order = np.lexsort((q, first))
    text, first, last, q = text[order], first[order], last[order], q[order]
    return text, first - begins[text], last - first, q


# ------------------------------------------------------------------ texts
def _read(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and at which word each text begins and the last ends."""
    parts = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    words, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[bounds - bounds[0]]


def describe(texts: pa.Array) -> list[pa.Array]:
    """Per text: number of words, runs, and the text without the repetitions of runs."""
    words, bounds = _read(texts)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text, start, length, q = runs_of(ids, bounds)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, bounds[text] + start + q, 1)
    np.add.at(cover, bounds[text] + start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(left, words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], ["start", "length", "period"])
    per = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    return [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(per, rows), collapsed.cast(pa.string())]


def periodic_runs(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of each, by start and then period) and collapsed.

    A run is a longest stretch of words with smallest period q and at least MIN_LENGTH words and
    MIN_PERIODS periods.  ``collapsed`` joins by one space the words that no run has after its first q.
    Words are separated by space and 0x09 to 0x0D.  A null, empty or blank text has no words, no runs
    and an empty collapsed text; each row is worked on alone, whatever its id, so repeated rows give
    equal results and an empty table none.  Columns of ``docs`` named like the new ones are replaced.
    """
    return add_by_text(docs, text_col, {"n_words": "bigint", "runs": RUNS, "collapsed": "string"}, lambda: describe, keep_text=keep_text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, exactly; of equal ones the first.  Null if there is none."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.reduce(runs, F.lit(None).cast(kind), better)


def repeated_from(text: Column, first: Column, period: Column) -> Column:
    """The words of ``text``, each from number ``first`` on replaced by the one of the ``period`` words there that its turn has.

    ``first`` and ``period`` are functions of the number of words.  A text without words is empty.
    """
    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        def edited(x: Column) -> Column:
            turn = lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))
            return F.array_join(F.transform(words, turn), " ")
        return F.when(n > 0, F.get(F.transform(F.array(F.struct(first(n).alias("a"), period(n).alias("p"))), edited), F.lit(0))).otherwise("")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), of), F.lit(0))
