"""Whitening of embeddings by a bidiagonal qd solver.

Blocks of centred rows are reduced to triangles by QR inside the tasks and the triangles to one
on the way together, so that the covariance is never formed and nothing is squared before the
solver.  The triangle is made bidiagonal by Householder reflections, dqds finds the squared
singular values to high relative accuracy, and a twisted factorisation at each of them gives the
direction.  What the driver holds is one triangle, of the size of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship
from quire.llm.vectors import blocks, summed, vectors_of

#: What is added to ``floor(64 * entry)``.
OFFSET = 1_000_000
#: Tasks that join the triangles of all others, before one joins theirs.
JOINERS = 64
EPS = float(np.finfo(np.float64).eps)
#: Neighbours whose relative gap is below this are made orthogonal to each other once more.
CLUSTERED = 1e-3
#: Sweeps for one value before the solver gives up (a handful is usual).
SWEEPS = 500


# --- small dense steps


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``h`` and ``beta`` with ``(I - beta h h') x`` along the first axis."""
    h = x.copy()
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return h, 0.0
    h[0] += norm if h[0] >= 0 else -norm
    return h, 2.0 / float(h @ h)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B and the orthogonal V with ``r = U B V'``."""
    work, d = r.astype(np.float64), r.shape[1]
    v = np.eye(d)
    for i in range(d):
        h, beta = reflector(work[i:, i])
        work[i:, i:] -= beta * np.outer(h, h @ work[i:, i:])
        if i + 2 < d:
            h, beta = reflector(work[i, i + 1 :])
            work[i:, i + 1 :] -= beta * np.outer(work[i:, i + 1 :] @ h, h)
            v[:, i + 1 :] -= beta * np.outer(v[:, i + 1 :] @ h, h)
    return np.diag(work).copy(), np.diag(work, 1).copy(), v


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One dqds step: the new q and e, the least d, and the place where d fell below zero (or -1)."""
    n, d = len(q), q[0] - shift
    new_q, new_e, least = [0.0] * n, [0.0] * (n - 1), d
    for k in range(n - 1):
        if d < 0:
            return new_q, new_e, d, k
        new_q[k] = d + e[k]
        if new_q[k] == 0.0:
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / new_q[k]
            new_e[k] = e[k] * t
            d = d * t - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least, (n - 1 if d < 0 else -1)


def dqds(q: list[float], e: list[float], moved: float = 0.0) -> list[float]:
    """Squared singular values of the bidiagonal whose squared entries are ``q`` and ``e``."""
    out: list[float] = []
    negligible = (10 * EPS) ** 2
    guess, left = 0.0, SWEEPS * max(1, len(q))
    while q:
        if len(q) == 1 or e[-1] <= negligible * (moved + q[-1]):
            out.append(moved + q[-1])
            q, e, guess = q[:-1], e[:-1], 0.0
            continue
        cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= negligible * (moved + min(q[i], q[i + 1]))), -1)
        if cut >= 0:
            return out + dqds(q[: cut + 1], e[:cut], moved) + dqds(q[cut + 1 :], e[cut + 1 :], moved)
        if (left := left - 1) < 0:
            raise ArithmeticError("the singular values do not converge")
        new_q, new_e, least, fell = sweep(q, e, guess)
        for _ in range(3):
            if fell < 0:
                break
            # a d that falls at the very end tells how much too large the shift was
            guess = guess + least if fell == len(q) - 1 and guess + least > 0 else guess / 4
            new_q, new_e, least, fell = sweep(q, e, guess)
        if fell >= 0:
            guess = 0.0
            new_q, new_e, least, fell = sweep(q, e, guess)
        q, e, moved, guess = new_q, new_e, moved + guess, max(least, 0.0)
    return out


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of ``B'B`` at one of its values, from the factorisation twisted where its pivot
    is least."""
    n = len(a)
    big, low = a * a, b / a[:-1]
    tiny = EPS * EPS * (float(big.max()) + 1e-300)
    down, s = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + big[i]
        pivot = pivot if pivot != 0.0 else tiny
        down[i] = big[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(n), np.zeros(n)
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] ** 2 + p[i + 1]
        t = big[i] / (pivot if pivot != 0.0 else tiny)
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    gamma[~np.isfinite(gamma)] = np.inf
    r = int(gamma.argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def inverse_iteration(a: np.ndarray, b: np.ndarray, value: float, known: np.ndarray, axis: int) -> np.ndarray:
    """Vector of ``B'B`` near a value, begun at an axis and kept orthogonal to known ones."""
    n = len(a)
    matrix = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    matrix -= (value + 8 * EPS * float(np.abs(matrix).max())) * np.eye(n)
    z = np.zeros(n)
    z[axis % n] = 1.0
    for _ in range(4):
        z -= known @ (known.T @ z)
        z = np.linalg.solve(matrix, z)
        z /= np.linalg.norm(z)
    return z


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``r'r``, falling, and its unit directions as columns, for the values above rounding."""
    a, b, v = bidiagonal(r)
    top = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    d = len(a)
    if top == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    # a zero on the diagonal stands for a direction that is left out in the end
    a = np.where(np.abs(a) < EPS * EPS * top, EPS * EPS * top, a)
    small = np.abs(b) <= EPS * d * (np.abs(a[:-1]) + np.abs(a[1:]))
    borders = [0, *(np.flatnonzero(small) + 1).tolist(), d]
    found = []
    for i, j in zip(borders, borders[1:], strict=False):
        for value in dqds((a[i:j] ** 2).tolist(), (b[i : j - 1] ** 2).tolist()):
            found.append((value, i, j))
    found.sort(key=lambda x: (-x[0], x[1]))
    found = [x for x in found if x[0] > EPS * d * found[0][0]]
    z = np.zeros((d, len(found)))
    begun = 0
    for c, (value, i, j) in enumerate(found):
        if c and found[c - 1][0] - value > CLUSTERED * found[c - 1][0]:
            begun = c
        z[i:j, c] = twisted(a[i:j], b[i : j - 1], value)
        same, block = z[:, begun:c], slice(i, j)
        for trial in range(j - i + 1):
            for _ in range(2):
                z[:, c] -= same @ (same.T @ z[:, c])
            if np.linalg.norm(z[:, c]) > 1e-3:
                break
            # the same direction again, of values equal but for rounding: another start
            z[:, c] = 0.0
            z[block, c] = inverse_iteration(a[block], b[i : j - 1], value, same[block], trial)
        z[:, c] /= np.linalg.norm(z[:, c])
    w = v @ z
    w *= np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)
    return np.array([x[0] for x in found]), w


# --- on Spark


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with per-dimension ``sums``; ``values`` of the covariance, falling, ``total``
    their sum over all dimensions, and the unit ``axes`` as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    total: float
    axes: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        return self.n * (x + OFFSET) - self.sums

    def white(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / float(self.n)) @ (self.axes / np.sqrt(self.values))


def triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of a QR decomposition of all centred rows."""
    d = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in blocks(batch, d):
                r = np.linalg.qr(np.vstack([r, (n * (x + OFFSET) - sums) / float(n)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for one in batch.column("r"):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(one.as_py()).reshape(-1, d)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    ship(rows.sparkSession)
    few = rows.mapInArrow(reduce, "r binary").repartition(JOINERS).mapInArrow(join, "r binary")
    one = few.repartition(1).mapInArrow(join, "r binary").collect()
    r = np.frombuffer(one[0]["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def fit(rows: DataFrame, length: int, components: int) -> Whitening | None:
    """Whitening of the rows of ``vectors_of``; none for no rows."""
    found = summed(rows, length, lambda x: np.zeros(len(x), np.int32)) if length else {}
    if not found:
        return None
    n, sums = found[0]
    total = np.array(sums, np.int64) + n * OFFSET
    r = triangle(rows, n, total)
    values, axes = directions(r)
    return Whitening(n, total, values[:components] / n, float((r * r).sum()) / n, axes[:, :components])


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    d, k = w.axes.shape
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in blocks(batch, d):
                y = w.white(w.deviations(x))
                gram += y.T @ y
                mean += y.sum(axis=0)
        flat = np.concatenate([gram.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "x"])

    ship(rows.sparkSession)
    sums = rows.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(k * k + k)
    for r in sums:
        flat[r["at"]] = r["x"]
    mean = flat[k * k :] / w.n
    return float(np.abs(flat[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 32, length: int | None = None) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for every
    kept vector and component.

    Entries become ``x = floor(64 * entry) + OFFSET``; components are numbered from 1 by falling
    variance, and those whose variance is zero but for rounding are left out, so a table of one
    row, of equal rows or of none gives no rows.  ``deviation`` is null where it would leave 64 bits.
    Rows whose vector is null, empty, of another length than most, or has an entry that is null,
    not finite or at least ``vectors.LARGEST`` are left out.  Repeated rows and ids each count, a
    null id stays null, other columns are not looked at.
    """
    rows = vectors_of(df, ident, vector, length)
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if length is None:
        sizes = rows.select(F.size("vector").alias("d")).limit(1).collect()
        length = sizes[0]["d"] if sizes else 0
    w = fit(rows, length, components)
    if w is None:
        return df.sparkSession.createDataFrame([], result)
    error = identity_error(rows, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = w.axes.shape
        for batch in batches:
            for part, x in blocks(batch, d):
                off = w.deviations(x)
                most = int(np.abs(off).max())
                if most * most * d < 1 << 63:
                    squares = pa.array((off * off).sum(axis=1))
                else:
                    exact = [sum(v * v for v in row) for row in off.tolist()]
                    squares = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                white = pa.array(w.white(off).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), white)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), squares, lists], ["vec_id", "deviation", "w"])

    made = rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(v / w.total)) for v in w.values)).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
