"""Whitening against numpy's eigenvectors, its solver against numpy's singular values."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from rankframe.llm import queries, whiten

G = np.random.default_rng(3)
Q = np.linalg.qr(G.normal(size=(200, 40)))[0]


@pytest.mark.parametrize("a", [
    G.normal(size=(500, 64)), G.normal(size=(30, 1)), Q, Q * np.repeat([1, 2, 3, 4], 10), np.eye(16), np.diag([3.0, 3, 2, 1e-9]),
    np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 12) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
    G.normal(size=(300, 20)) * 10.0 ** -np.arange(20), np.hstack([Q[:, :9], Q[:, :9]]), np.hstack([Q, np.zeros((200, 3))]), np.ones((50, 6)), np.zeros((9, 4))])
def test_solver(a):
    squares, v = whiten.right_singular(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.abs(np.sqrt(squares) - want).max() <= 1e-14 * max(want[0], 1e-300) * len(want)
    kept = squares > (whiten.NO_SPREAD ** 2) * squares[0]
    v, squares = v[:, kept], squares[kept]
    assert np.abs(v.T @ v - np.eye(len(squares))).max(initial=0) < 1e-9
    assert np.abs(a.T @ (a @ v) - v * squares).max(initial=0) <= 1e-11 * max(want[0] ** 2, 1e-300)


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal matrix: dqds holds each value to its own last digits, as exact arithmetic has them."""
    from fractions import Fraction
    d, e = [1.0, 1e-4, 1e-8], [1e-3, 1e-7]
    squares = whiten.singular_squares(np.array(d), np.array(e))
    t = [[Fraction(0)] * 3 for _ in range(3)]
    for i in range(3):
        t[i][i] = Fraction(d[i]) ** 2 + (Fraction(e[i - 1]) ** 2 if i else 0)
        if i < 2:
            t[i][i + 1] = t[i + 1][i] = Fraction(d[i]) * Fraction(e[i])

    def below(x):  # eigenvalues below x by the signs of exact pivots
        count, p = 0, None
        for i in range(3):
            p = t[i][i] - x - (t[i][i - 1] ** 2 / p if i else 0)
            count += p < 0
        return count
    for k, s in enumerate(sorted(squares)):
        assert below(Fraction(s) * (1 - Fraction(1, 10**13))) <= k < below(Fraction(s) * (1 + Fraction(1, 10**13)))


def plain(rows):
    """vec_id, n, deviation, whitened (up to sign), explained, from numpy."""
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in rows], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    m = min(32, int((e > 1e-20 * e[0]).sum()))
    return n, deviation, (centred @ v / np.sqrt(np.abs(e)))[:, :m], e[:m] / e.sum()


def compare(got, rows):
    n, deviation, white, explained = plain(rows)
    m = white.shape[1]
    assert len(got) == len(rows) * m
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [r.component for r in got] == list(range(1, m + 1)) * len(rows)
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::m]] == deviation
    mine = np.array([r.whitened for r in got]).reshape(-1, m)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-7
    assert np.abs(np.array([r.explained for r in got[:m]]) - explained).max() < 1e-10
    (error,) = {r.identity_error for r in got}
    assert 0 <= error < 1e-9 and np.abs(mine.T @ mine / n - np.outer(mine.mean(0), mine.mean(0)) - np.eye(m)).max() < 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    compare(queries.op12_whiten(spark, SMALL).collect(), rows)


def test_blocks_and_tree_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whiten, "FAN_IN", 3)
    rows = [(i, (G.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(23)
    compare(whiten.whiten(table.select("vec_id", whiten.fixed_point(table.v).alias("vector"))).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, (G.normal(size=4) * [4, 3, 2, 1]).tolist()) for i in range(60)] + [(60, [0.0, 0.0, 0.0, 0.0])] * 1
    rows = good + [(70, None), (71, [1.0, None, 2.0, 3.0]), (72, [nan, 1.0, 1.0, 1.0]), (73, [inf, 1.0, 1.0, 1.0]), (74, []), (75, [1.0, 2.0]), (76, [-inf, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, v array<double>, x int, n string")
    found = whiten.whiten(table.select("vec_id", "x", "n", whiten.fixed_point(table.v).alias("vector")))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), good)
    equal = spark.createDataFrame([(i, [1, 2, 3]) for i in range(5)], "vec_id long, vector array<long>")
    assert whiten.whiten(equal).count() == 0 and whiten.whiten(equal.filter("false")).count() == 0
    flat = [(i, [i * 10, 2 * i * 10, 7 + (i % 2)]) for i in range(50)]  # two dimensions alike, one direction empty
    got = whiten.whiten(spark.createDataFrame(flat, "vec_id long, vector array<long>"), components=3).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-6
    wide = spark.createDataFrame([(None, [1e300, 0.0]), (1, [-1e300, 1.0]), (1, [-1e300, 1.0])], "vec_id long, v array<double>")
    assert whiten.whiten(wide.select("vec_id", whiten.fixed_point(wide.v).alias("vector"))).count() >= 3
