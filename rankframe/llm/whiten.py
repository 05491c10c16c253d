"""Whitening of vectors through a bidiagonal qd solver.

The rows, centred exactly, are reduced to one triangular factor R: each task takes the QR
decomposition of one block of rows after the other, each stacked on the R before, and the tasks' Rs
are stacked and reduced in a tree.  R has as many columns as the vectors, whatever the number of
rows.  Householder reflections make it bidiagonal, the differential qd algorithm with shifts (dqds)
gives its singular values to high relative accuracy, and a twisted factorisation of the bidiagonal's
product gives each one's direction.  No covariance matrix is formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import cut_lineage

#: Rows of a block that a task reduces at a time, and Rs that a step of the tree stacks.
BLOCK_ROWS = 4096
FAN_IN = 16
COMPONENTS = 32
EPS = np.finfo(np.float64).eps
#: Singular values nearer than this share of the larger are taken as a cluster.
CLUSTER = 1e-3
#: Directions with a smaller share of the largest singular value are taken as empty.
NO_SPREAD = 1e-12


# ------------------------------------------------------------------ solver
def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right reflections V): U' r V is upper bidiagonal for some orthogonal U."""
    a, n = np.array(r, np.float64), r.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = np.linalg.norm(x)
        if norm == 0:
            return x, 0.0
        u = x.copy()
        u[0] += np.copysign(norm, x[0])
        return u, 2.0 / (u @ u)

    for k in range(n):
        u, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(u, u @ a[k:, k:])
        if k + 2 < n:
            u, beta = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform: the new q and e, and the first d below 0 (0 if there is none)."""
    n, new_q, new_e = len(q), [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return new_q, new_e, d
        new_q[k] = d + e[k]
        t = q[k + 1] / new_q[k] if new_q[k] else np.inf
        if not np.isfinite(t):
            return new_q, new_e, -1.0
        new_e[k] = e[k] * t
        d = d * t - shift
    new_q[n - 1] = d
    return new_q, new_e, min(d, 0.0)


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds with deflation."""
    done, todo = [], [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while todo:
        (q, e, moved), sweeps = todo.pop(), 0
        while q:
            sweeps += 1
            if sweeps > 100 * (len(diagonal) + 1):
                raise ArithmeticError("no convergence")
            if max(q) + max(e, default=0.0) <= EPS / 4 * moved:  # all that is left is rounding of the shifts
                done += [moved + x for x in q]
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= (4 * EPS) ** 2 * (moved + min(q[k], q[k + 1]))), None)
            if len(q) == 1 or cut == len(e) - 1:
                done.append(moved + q.pop())
                e = e[:-1]
                continue
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the small ones to the end
                q, e = q[::-1], e[::-1]
            # the last two rows' smaller eigenvalue is near the smallest of all, and not below it
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            shift = max(0.0, ((a + b) / 2 - float(np.hypot((a - b) / 2, np.sqrt(c)))) * (1 - 2 * EPS))
            for attempt in range(4):
                new_q, new_e, below = _dqds(q, e, shift)
                if below == 0.0:
                    break
                if attempt == 3:
                    raise ArithmeticError("not a number, or no convergence")
                shift = 0.0 if attempt == 2 else shift / 4 if attempt else max(0.0, (shift + below) * (1 - 2 * EPS))
            q, e, moved = new_q, new_e, moved + shift
    return np.sort(np.array(done))[::-1]


class Twisted:
    """Twisted factorisation of L D L' - x, the bidiagonal's product in the form unit lower bidiagonal L, diagonal D."""

    def __init__(self, d: np.ndarray, low: np.ndarray, x: float):
        n, tiny = len(d), EPS * EPS * max(float(np.abs(d).max()), np.finfo(float).tiny)
        self.down, self.up = np.zeros(n), np.zeros(n)
        self.l, self.u = np.zeros(n), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        s[0], p[-1] = -x, d[-1] - x
        for k in range(n - 1):
            plus = s[k] + d[k]
            self.down[k] = plus if abs(plus) > tiny else tiny
            self.l[k] = d[k] * low[k] / self.down[k]
            s[k + 1] = self.l[k] * low[k] * s[k] - x
        self.down[-1] = s[-1] + d[-1]
        for k in range(n - 2, -1, -1):
            minus = d[k] * low[k] ** 2 + p[k + 1]
            self.up[k + 1] = minus if abs(minus) > tiny else tiny
            t = d[k] / self.up[k + 1]
            self.u[k] = low[k] * t
            p[k] = p[k + 1] * t - x
        gamma = s + p + x
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.at] if abs(gamma[self.at]) > tiny else tiny

    def _back(self, z: np.ndarray) -> np.ndarray:
        for k in range(self.at - 1, -1, -1):
            z[k] -= self.l[k] * z[k + 1]
        for k in range(self.at, len(z) - 1):
            z[k + 1] -= self.u[k] * z[k]
        return z

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.down))
        z[self.at] = 1.0
        z = self._back(z)
        return z / np.linalg.norm(z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        z, r = y.copy(), self.at
        for k in range(r):
            z[k + 1] -= self.l[k] * z[k]
        for k in range(len(z) - 2, r - 1, -1):
            z[k] -= self.u[k] * z[k + 1]
        z[:r] /= self.down[:r]
        z[r] /= self.gamma
        z[r + 1:] /= self.up[r + 1:]
        return self._back(z)


def _directions(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unsplit upper bidiagonal matrix for its falling squares.

    Within a cluster a vector that is not clear of its neighbours is found by inverse iteration with
    the twisted factorisation, held orthogonal to those before.
    """
    d, low, out = diagonal ** 2, above / diagonal[:-1], np.zeros((len(diagonal), len(squares)))
    rng, first = np.random.default_rng(0), 0
    for k, x in enumerate(squares):
        if k and squares[k - 1] - x > CLUSTER * squares[k - 1]:
            first = k
        before = out[:, first:k]
        z = Twisted(d, low, x).vector()
        rest = z - before @ (before.T @ z)
        if before.shape[1]:
            factors = Twisted(d, low, x * (1 - 4 * EPS * (k - first)))
            for attempt in range(8):
                if np.linalg.norm(rest) < 0.1:
                    rest = rng.normal(size=len(d))
                z = factors.solve(rest / np.linalg.norm(rest))
                z /= np.linalg.norm(z)
                rest = z - before @ (before.T @ z)
                rest -= before @ (before.T @ rest)
                if np.linalg.norm(rest) > 0.9 and attempt > 1:
                    break
        out[:, k] = rest / np.linalg.norm(rest)
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right singular vectors as columns) of a square triangular factor.

    Vectors of values that are empty (NO_SPREAD) are not told apart.
    """
    size = np.abs(r).max(initial=0)
    if size == 0:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    diagonal, above, v = bidiagonalise(r / size)
    # an empty diagonal entry is raised within rounding of the whole, so that L exists
    diagonal = np.where(np.abs(diagonal) < EPS / 64, EPS / 64, diagonal)
    cuts = [0, *[k + 1 for k in range(len(above)) if abs(above[k]) <= EPS * min(abs(diagonal[k]), abs(diagonal[k + 1]))], len(diagonal)]
    squares, vectors = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = singular_squares(diagonal[a:b], above[a:b - 1])
        z = np.zeros((len(diagonal), b - a))
        z[a:b] = _directions(diagonal[a:b], above[a:b - 1], part)
        squares.append(part)
        vectors.append(z)
    squares, vectors = np.concatenate(squares), np.concatenate(vectors, axis=1)
    order = np.argsort(-squares, kind="stable")
    return squares[order] * size**2, v @ vectors[:, order]


# ------------------------------------------------------------------ rows
@dataclass
class Whitening:
    """What whitening takes: rows counted and their sums, directions (columns) with variances, the sum of all variances."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of squares of n * x - sums, exactly; null where a long has no room for it."""
        apart = self.n * x - self.sums
        exact, about = (apart * apart).sum(axis=1), (apart.astype(np.float64) ** 2).sum(axis=1)
        return pa.array(exact, pa.int64(), mask=about > 9.2e18)


def fixed_point(vector: Column, scale: int = 64, offset: int = 1_000_000, limit: float = 2.0**40) -> Column:
    """floor(scale * c) + offset of every entry as long; null for a vector that is null or has a null or non-finite entry.

    Products beyond ``limit`` count as the limit, so that sums over all rows stay exact.
    """
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(limit)), F.lit(-limit))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda c: F.floor(held(c)) + F.lit(offset).cast("long")))


def _blocks(batches, dims: int | None = None, rows: int = BLOCK_ROWS):
    """(batch, its vectors as a matrix) in blocks of at most ``rows`` rows; the vector is the last column."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield part, flat if dims is None else flat.reshape(-1, dims)


def moments(vectors: DataFrame) -> tuple[int, np.ndarray] | None:
    """(rows, sums per dimension) of the commonest length of ``vectors`` (one column; of equally common ones the longest)."""
    def run(batches):
        found: dict[int, list] = {}
        for part, flat in _blocks(batches):
            size = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
            begins = np.cumsum(size) - size
            for d in np.unique(size):
                at = begins[size == d]
                x = flat[at[:, None] + np.arange(d)]
                n, sums = found.get(d, (0, np.zeros(d, np.int64)))
                found[d] = (n + len(x), sums + x.sum(axis=0))
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    parts = cut_lineage(vectors.mapInArrow(run, "dims int, n bigint, sums array<bigint>"), "whiten-moments")
    best = parts.filter("dims > 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return None
    sums = parts.filter(F.col("dims") == best["dims"]).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    return best["n"], np.array([r["s"] for r in sums.orderBy("at").collect()], np.int64)


def _stacked(rs: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rs), mode="r")


def triangular(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows: blocks in each task, then the tasks' Rs in a tree of FAN_IN."""
    dims, centre = len(sums), Whitening(n, sums, None, None, 0.0)

    def run(batches):
        from pyspark import TaskContext
        r = np.zeros((0, dims))
        for _, x in _blocks(batches, dims):
            r = _stacked([r, centre.centred(x)])
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def merge(given: pa.Table) -> pa.Table:
        given = given.sort_by("part")
        rs = [np.frombuffer(x.as_py(), np.float64).reshape(-1, dims) for x in given["r"]]
        return pa.table({"part": pa.array([given["part"][0].as_py() // FAN_IN], pa.int64()), "r": pa.array([_stacked(rs).tobytes()], pa.binary())})

    parts = cut_lineage(vectors.mapInArrow(run, "part bigint, r binary"), "whiten-r")
    left = parts.agg(F.max("part")).first()[0] + 1
    while left > 1:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, "part bigint, r binary"), "whiten-r")
        left = -(-left // FAN_IN)
    r = np.frombuffer(bytes(parts.first()["r"]), np.float64).reshape(-1, dims)
    return np.concatenate([r, np.zeros((dims - len(r), dims))])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors (one column of arrays of long, none null); None if there is none."""
    met = moments(vectors)
    if met is None:
        return None
    n, sums = met
    r = triangular(vectors.filter(F.size(vectors.columns[0]) == len(sums)), n, sums)
    squares, directions = right_singular(r)
    m = int((squares[:components] > NO_SPREAD**2 * max(squares[0], 1e-300)).sum())
    directions = directions[:, :m]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(m)])
    return Whitening(n, sums, directions * signs, squares[:m] / n, float((r * r).sum() / n))


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    m, dims = len(w.variances), len(w.sums)

    def run(batches):
        total = np.zeros((m + 1, m))
        for _, x in _blocks(batches, dims):
            y = w.whitened(x)
            total += np.concatenate([y.T @ y, y.sum(axis=0)[None]])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    sums = vectors.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r["v"] for r in sums]).reshape(m + 1, m) / w.n
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max(initial=0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "vector", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    ``vec_col`` holds arrays of long (:func:`fixed_point`).  Rows whose vector is null, empty, or of
    another length than the commonest one (of equally common ones the longest) are left out; repeated
    rows and null ids count like any other.  Components are numbered from 1 by falling variance; those
    without spread (NO_SPREAD of the largest) cannot be whitened and are left out, so equal vectors
    alone and an empty table give no rows.  Each direction's largest entry is positive.
    """
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x")).filter("x IS NOT NULL")
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    w = fit(given.select("x"), components)
    if w is None or not len(w.variances):
        return rows.sparkSession.createDataFrame([], schema)
    given, m, explained = given.filter(F.size("x") == len(w.sums)), len(w.variances), w.variances / w.total
    error = identity_error(given.select("x"), w)

    def run(batches):
        for part, x in _blocks(batches, len(w.sums)):
            at = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), w.n, np.int64)),
                 w.deviation(x).take(at), pa.array(w.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(run, schema)
