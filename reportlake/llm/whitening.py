"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Centred rows are compressed to a triangular factor R by
a tall-skinny QR: each task folds its rows into one factor block by block, and factors are folded together by groups of
``fan`` until one is left, so that no task holds more than ``fan`` factors or one block, whatever the number of rows. R has
the singular values and right singular vectors of all centred rows, with no squared numbers formed. Plane rotations then
make R's columns orthogonal, sweep by sweep, many disjoint pairs at a time; the product of the rotations holds the
components, and column norms over sqrt(n) the standard deviations, small ones as accurately as large ones.

Rows are read four times (sums; factor; covariance of the outcome; result), and none is shuffled: only sums, factors
(dimensions x dimensions each, one for each task) and 8 x 8 sums move. The driver holds one factor: the square of the
vectors' length.

Defined cases: a vector that is null or holds null, NaN or infinite entries is left out, and so is one whose length is not
the commonest (of equally common lengths, the longest); null and repeated vec_ids are rows like others; of equal
eigenvalues any basis is right; directions without variance (an eigenvalue below 1e-24 of the first, which is rounding)
have null in ``whitened`` and are not part of ``identity_error``, and without any variance ``explained`` and ``identity_error`` are null, too; a
``deviation`` too large for a long is null; entries beyond a long's range are held at its ends; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import trimmed, written

SCALE, SHIFT = 1024.0, 100_000
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    components: int = 8
    block_bytes: int = 4 << 20  # of centred rows that are folded into a factor at once
    fan: int = 32  # factors folded together by one task
    sweeps: int = 60


@dataclass(frozen=True)
class Fit:
    """Rows, sums by dimension, eigenvalues (all, falling), their vectors in columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def sound(self) -> np.ndarray:
        """Which eigenvalues are more than rounding."""
        return self.values > 1e-24 * self.values[0] if len(self.values) and self.values[0] > 0 else np.zeros(len(self.values), bool)


# ---------------------------------------------------------------------------- linear algebra of one factor


def folded(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of r's rows and more rows."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns as rounds of disjoint pairs (a tournament: one stands, the others move on by one)."""
    players = list(range(d + d % 2))
    out = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(min(p), max(p)) for p in zip(players[:half], players[half:][::-1], strict=True) if max(p) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors in columns) of r, falling: one-sided rotations until all columns are orthogonal."""
    a, v = r.astype(np.float64).T.copy(), np.eye(r.shape[1])  # columns as rows
    tiny = np.finfo(np.float64).eps * np.sqrt(r.shape[1])
    plan = rounds(r.shape[1])
    for _ in range(sweeps):
        turned = 0
        for p, q in plan:
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            turn = np.abs(xy) > tiny * np.sqrt(xx) * np.sqrt(yy)
            if not turn.any():
                continue
            turned += int(turn.sum())
            p, q = p[turn], q[turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = (1 / np.hypot(1, t))[:, None]
            s = c * t[:, None]
            for m in (a, v):
                x, y = m[p], m[q]
                m[p], m[q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = np.sqrt((a * a).sum(1))
    order = np.argsort(-size, kind="stable")
    return size[order], v[order].T


# ---------------------------------------------------------------------------- passes over the rows


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that count."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("embedding")).where(F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False)))
    by_length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (by_length["d"] if by_length else -1))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """x of a column of lists of one length, as a matrix of int64."""
    flat = np.asarray(column.flatten())
    scaled = np.floor(SCALE * flat)
    top = float(1 << 62)
    if len(flat) and np.abs(scaled).max() >= top:
        held = [max(-LONGEST - 1, min(LONGEST, int(c) + SHIFT)) if np.isfinite(c) else (LONGEST if c > 0 else -LONGEST - 1) for c in scaled]
        return np.array(held, np.int64).reshape(len(column), -1)
    return (scaled.astype(np.int64) + SHIFT).reshape(len(column), -1 if len(flat) else 0)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums by dimension): halves of 32 bits are summed apart, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for b in batches:
            x = whole_numbers(b.column(0))
            h, w = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            n, high, low = n + len(x), h if high is None else high + h, w if low is None else low + w
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(-1, len(high), dtype=np.int32), "high": np.append([0], high), "low": np.append([n], low)})

    got = rows.select("embedding").mapInArrow(trimmed(run), "d int, high long, low long").groupBy("d").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    of = {r["d"]: (r["high"] << 32) + r["low"] for r in got.collect()}  # a row for each dimension
    return of.pop(-1, 0), [of[k] for k in sorted(of)]


def centred(x: np.ndarray, n: int, total: tuple[int, ...] | list[int]) -> np.ndarray:
    """x - S / n in doubles: the whole part of the mean is taken away exactly."""
    whole = np.array([min(LONGEST, max(-LONGEST - 1, s // n)) for s in total], np.int64)
    part = np.array([(s % n) / n for s in total])
    if len(x) and max(np.abs(x).max(), np.abs(whole).max()) >= 1 << 61:
        return x.astype(np.float64) - whole.astype(np.float64) - part
    return (x - whole).astype(np.float64) - part


def factor(rows: DataFrame, n: int, total: list[int], s: Settings = Settings()) -> np.ndarray:
    """R of all centred rows."""
    spark, d = rows.sparkSession, len(total)
    block = max(2 * d, s.block_bytes // (8 * max(1, d)))
    form = "place long, r binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = None, [], 0
        for b in batches:
            x = centred(whole_numbers(b.column(0)), n, total)
            for k in range(0, len(x), block):
                held.append(x[k : k + block])
                size += len(held[-1])
                if size >= block:
                    r, held, size = folded(r, np.vstack(held)), [], 0
        if held:
            r = folded(r, np.vstack(held))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for one in b.column("r"):
                r = folded(r, np.frombuffer(one.as_py(), np.float64).reshape(-1, d))
        yield pa.RecordBatch.from_pydict({"place": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    now = written(rows.select("embedding").mapInArrow(trimmed(first), form), "whiten-factors")
    while True:
        count, last = now.agg(F.count(F.lit(1)), F.max("place")).first()
        if count <= 1:
            break
        # Places are task numbers, with gaps: dense enough, since nearly every task has rows.
        now = written(now.groupBy(F.floor(F.col("place") / s.fan).alias("group")).applyInArrow(joined, form), "whiten-factors")
    one = now.first()
    return np.frombuffer(one["r"], np.float64).reshape(-1, d) if one else np.zeros((0, d))


def fit(vectors: DataFrame, s: Settings = Settings()) -> Fit:
    """Components of all usable rows."""
    rows = usable(vectors)
    n, total = sums(rows)
    if not n or not total:
        return Fit(n, tuple(total), np.zeros(0), np.zeros((len(total), 0)))
    size, v = jacobi(factor(rows, n, total, s), s.sweeps)
    return Fit(n, tuple(total), size * size / n, v)


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2: in 64 bits where they fit, in Python's numbers where not; null above a long."""
    about = ((x.astype(np.float64) * f.n - np.array(f.sums, np.float64)) ** 2).sum(1) if len(x) else np.zeros(0)
    safe = (about < 2.0**61) & (np.abs(x).astype(np.float64).max(1, initial=0) * f.n < 2.0**61) if len(x) else np.zeros(0, bool)
    out: list[int | None] = [None] * len(x)
    if safe.any():
        y = x[safe] * np.int64(f.n) - np.array(f.sums, np.int64)
        for k, value in zip(np.flatnonzero(safe), (y * y).sum(1).tolist(), strict=True):
            out[k] = value
    for k in np.flatnonzero(~safe):
        value = sum((f.n * int(c) - t) ** 2 for c, t in zip(x[k], f.sums, strict=True))
        out[k] = value if value <= LONGEST else None
    return out


def _whitened(column: pa.Array, f: Fit, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, whitened rows); columns without variance are zero."""
    x = whole_numbers(column)
    scale = np.where(f.sound[:m], 1 / np.sqrt(np.where(f.sound[:m], f.values[:m], 1)), 0)
    return x, (centred(x, f.n, f.sums) @ f.vectors[:, :m]) * scale


def identity_error(rows: DataFrame, f: Fit, m: int) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(m), np.zeros((m, m))
        for b in batches:
            w = _whitened(b.column(0), f, m)[1]
            one, two = one + w.sum(0), two + w.T @ w
        yield pa.RecordBatch.from_pydict({"at": np.arange(m * m + m, dtype=np.int32), "total": np.concatenate([one, two.ravel()])})

    good = np.flatnonzero(f.sound[:m])
    if not len(good):
        return None
    got = rows.select("embedding").mapInArrow(trimmed(run), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    flat = np.array([r["total"] for r in got]) / f.n
    covariance = flat[m:].reshape(m, m) - np.outer(flat[:m], flat[:m])
    return float(np.abs(covariance[np.ix_(good, good)] - np.eye(len(good))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, f = usable(vectors), fit(vectors, s)
    m = min(s.components, f.vectors.shape[1])
    error = identity_error(rows, f, m) if m else None
    trace = float(f.values.sum())
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not m:
                continue
            x, w = _whitened(b.column(1), f, m)
            rows_ = len(x)
            again = np.repeat(np.arange(rows_), m)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * m, f.n)),
                    pa.array(deviations(x, f), pa.int64()).take(pa.array(again)), pa.array(w.ravel(), mask=np.tile(~f.sound[:m], rows_)),
                    pa.array(np.tile(f.values[:m] / trace if trace > 0 else np.zeros(m), rows_), mask=np.full(rows_ * m, not trace > 0)),
                    pa.array(np.full(rows_ * m, error or 0.0), mask=np.full(rows_ * m, error is None)),
                ],
                names,
            )

    return rows.mapInArrow(trimmed(run), RESULT)
