"""Periodic runs against a search over all periods, the transform against direct sums."""

import random
import re

import numpy as np
import pytest

from rankframe.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def repetitive(r):
    w = []
    for _ in range(r.randint(0, 5)):
        part = [str(r.randint(0, r.choice((1, 3, 50)))) for _ in range(r.choice((1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 33, 64)))]
        w += (part * r.randint(1, 9))[:r.randint(1, 300)] + [str(r.randint(0, 50)) for _ in range(r.randint(0, 9))]
    return w


def famous():
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    thue = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    return [fib[-1], thue, thue[:100] * 4, ["x"] * 1000, ["x"] * 23, ["x"] * 24, list("abcdefgh") * 3, list("abcdefghi") * 3]


@pytest.mark.parametrize("most_block, direct", [(1 << 15, 64), (16, 8)])
def test_runs_are_those_of_every_period(monkeypatch, most_block, direct):
    monkeypatch.setattr(periodic, "MOST_BLOCK", most_block)
    monkeypatch.setattr(periodic, "_DIRECT", direct)
    periodic._transform.cache_clear()
    r = random.Random(5)
    texts = [repetitive(r) for _ in range(150)] + famous() + [[]]
    numbers = {w: i for i, w in enumerate({w for t in texts for w in t})}
    ids = np.array([numbers[w] for t in texts for w in t], np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [[] for _ in texts]
    for t, *run in zip(*[x.tolist() for x in periodic.runs_of(ids, bounds)]):
        got[t].append(tuple(run))
    assert got == [plain_runs(t) for t in texts]
    periodic._transform.cache_clear()


@pytest.mark.parametrize("block", [8, 64, 512])
def test_zero_mismatches_are_those_of_direct_sums(block):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 8 * block)
    values[block:4 * block] = np.tile(values[:block // 2], 6)
    at = np.array([0, block, 2 * block])
    squares = np.concatenate([[0], np.cumsum(values * values)])
    row, d = periodic.zero_mismatches(values.astype(float), squares, at, np.full(3, block), block)
    want = [(i, q) for i, s in enumerate(at) for q in range(block, 2 * block)
            if ((values[s:s + block] - values[s + q:s + q + block]) ** 2).sum() % periodic.PRIME == 0]
    assert list(zip(row, d)) == want and want


def test_span_hashes_that_clash_are_found_out(monkeypatch):
    real = periodic.Spans.equal
    wrong = lambda self, x, d, n: np.ones(len(x), bool) if self.round == 0 else real(self, x, d, n)
    made = periodic.Spans.__init__
    monkeypatch.setattr(periodic.Spans, "__init__", lambda self, ids, round: (made(self, ids, round), setattr(self, "round", round))[0])
    monkeypatch.setattr(periodic.Spans, "equal", wrong)
    ids = np.array([5, 6, 7] + [1, 2, 3] * 20 + [9, 8], np.int32)
    assert [x.tolist() for x in periodic.runs_of(ids, np.array([0, len(ids)]))] == [[0], [3], [60], [3]]


def test_texts_runs_and_collapsed(spark):
    r = random.Random(2)
    long = " ".join(str(r.randint(0, 9999)) for _ in range(60_000)) + " loop of words" * 9
    texts = [None, "", " \n\t ", "one", " a b\tc  " * 12, "x " * 5000, long, long] + [" ".join(repetitive(r)) for _ in range(30)]
    rows = [(None if i == 3 else i // 2, t, "r", "c", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, block int")
    found = periodic.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "block", "n_words", "runs", "collapsed"]
    best = {x.text: x.best for x in found.withColumn("best", periodic.strongest(found.runs)).collect()}
    got = found.collect()
    assert len(got) == len(rows) and all(x.block == 7 for x in got)
    for x in got:
        w = WORD.findall(x.text or "")
        runs = plain_runs(w) if x.text != long else [(60_000, 27, 3)]
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert [tuple(y) for y in x.runs] == runs and x.n_words == len(w)
        assert x.collapsed == " ".join(y for i, y in enumerate(w) if i not in gone)
        want = min(runs, key=lambda y: (-y[1] / y[2], y[0], y[2])) if runs else None
        assert (tuple(best[x.text]) if best[x.text] else None) == want
    assert periodic.periodic_runs(docs.filter("false")).count() == 0
