"""Embedding whitening: one-sided Jacobi on the triangle that blockwise QR leaves of all centred rows.

Every task reduces its rows, block by block, to one upper triangle (TSQR); triangles are merged a few at a time until
one is left. Plane rotations make its columns orthogonal; accumulated, they are the components, and the columns'
lengths are the standard deviations. Neither a covariance nor a product of rows is formed, so that small deviations
keep their digits. The driver holds squares of the dimension only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, in_arrow, written

COMPONENTS = 32
#: What an entry is multiplied by before it is cut to a whole number, and what is added then.
SCALE, SHIFT = 64, 1_000_000
#: Entries of whole numbers beyond this count as it.
LARGEST = 1 << 62
#: Numbers in a block of rows that one QR takes, about.
BLOCK = 1 << 20
#: Partial results that one task merges.
FAN = 16
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` rows with sums ``sums`` in each dimension; components in columns by falling deviation."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles, from exact differences."""
        return _differences(x, self.n, self.sums).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of doubles, as whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * vectors)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - S, exactly: in 64 bits where they fit, else as Python's whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if n * most < LARGEST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums of squares of n*x - S; None where one doesn't fit into 64 bits."""
    d = _differences(x, n, sums)
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return (d * d).sum(1).tolist()
    wide = d.astype(object)
    return [t if t < 1 << 63 else None for t in (wide * wide).sum(1).tolist()]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (doubles) of rows whose vector isn't null or empty and has neither null nor non-finite entries."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("vec"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.coalesce((F.size("vec") > 0) & F.forall("vec", fine), F.lit(False)))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length, as matrices of whole numbers."""
    for b in batches:
        if b.num_rows:
            yield b, whole(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, dim, n, high, low: counts and sums of one partition by vectors' length; sums are high * 2^32 + low."""
    held: dict[int, list] = {}
    for b in batches:
        sizes = np.diff(b.column("vec").offsets.to_numpy())
        flat = b.column("vec").flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(sizes, sizes)
        for size in np.unique(sizes).tolist():
            x = whole(flat[of == size].reshape(-1, size))
            t = held.setdefault(size, [0, np.zeros(size, np.int64), np.zeros(size, np.int64)])
            t[0] += len(x)
            t[1] += (x >> 32).sum(0)
            t[2] += (x & 0xFFFFFFFF).sum(0)
    for size, (n, high, low) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(high), pa.array(low)], names=["size", "dim", "n", "high", "low"])


def folded(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> bytes | None:
    """All ``part``s (at int, part binary) merged, ``FAN`` at a time; None if there are none.

    ``at`` is the place of the task that made the part, so that merges don't depend on timing.
    """

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"at": pa.array([t.column("at")[0].as_py() // FAN], pa.int32()), "part": pa.array([merge(t.column("part").to_pylist())], pa.binary())})

    parts = written(parts, name)
    while parts.count() > 1:
        parts = written(parts.groupBy(F.floor(F.col("at") / FAN)).applyInArrow(together, "at int, part binary"), name)
    last = parts.first()
    return None if last is None else bytes(last["part"])


def _one(part: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part], pa.binary())], names=["at", "part"])


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangle(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """An upper triangle R with R'R = n * covariance, by TSQR over ``rows`` (vec)."""
    d = len(sums)
    most = max(d, BLOCK // d)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, held = np.zeros((0, d)), [], 0
        for _, x in _matrices(batches):
            waiting.append(_differences(x, n, sums).astype(np.float64) / n)
            held += len(x)
            if held >= most:
                r, waiting, held = _triangle(np.vstack([r, *waiting])), [], 0
        if held:
            r = _triangle(np.vstack([r, *waiting]))
        if len(r):
            yield _one(np.ascontiguousarray(r).tobytes())

    merge = lambda parts: np.ascontiguousarray(_triangle(np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts]))).tobytes()
    return np.frombuffer(folded(in_arrow(rows.select("vec"), reduce, "at int, part binary"), merge, "triangles")).reshape(-1, d)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors, in columns.

    Every step of a sweep rotates disjoint pairs of columns side by side; sweeps end when no two columns are further
    from orthogonal than rounding. Columns that are rounding themselves are left alone. The sign of a vector makes
    its largest entry positive.
    """
    d, eps = r.shape[1], np.finfo(float).eps
    a, v = r.T.copy(), np.eye(d)  # columns of r, and of the rotations, lie in rows here
    around = np.arange(d + d % 2)
    half = len(around) // 2
    for _ in range(SWEEPS):
        worst, nothing = 0.0, (eps * eps) * float((a * a).sum())
        for _ in range(len(around) - 1):
            p, q = around[:half], around[half:][::-1]
            p, q = p[(p < d) & (q < d)], q[(p < d) & (q < d)]
            ap, aq = a[p], a[q]
            pp, qq, pq = (ap * ap).sum(1), (aq * aq).sum(1), (ap * aq).sum(1)
            big = np.minimum(pp, qq) > nothing
            off = np.where(big, np.abs(pq) / np.sqrt(np.where(big, pp * qq, 1)), 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > eps
            if turn.any():
                p, q, ap, aq = p[turn], q[turn], ap[turn], aq[turn]
                z = (qq[turn] - pp[turn]) / (2 * pq[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                a[p], a[q] = c * ap - s * aq, s * ap + c * aq
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
            around = np.concatenate([around[:1], around[-1:], around[1:-1]])
        if worst <= 8 * eps * d:
            break
    else:
        raise ArithmeticError(f"columns aren't orthogonal after {SWEEPS} sweeps: {worst}")
    sigma = np.sqrt((a * a).sum(1))
    order = np.argsort(-sigma, kind="stable")
    v = v[order]
    v *= np.sign(v[np.arange(d), np.abs(v).argmax(1)])[:, None]
    return sigma[order], v.T


def _moments(w: np.ndarray) -> bytes:
    """n, mean and centred products of some rows."""
    mean = w.mean(0)
    c = w - mean
    return np.concatenate([[len(w)], mean, (c.T @ c).ravel()]).tobytes()


def _merged_moments(parts: list[bytes], k: int) -> bytes:
    n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
    for p in map(np.frombuffer, parts):
        m, step = p[0], p[1 : k + 1] - mean
        m2 = m2 + p[k + 1 :].reshape(k, k) + np.outer(step, step) * (n * m / (n + m))
        mean, n = mean + step * (m / (n + m)), n + m
    return np.concatenate([[n], mean, m2.ravel()]).tobytes()


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of ``usable`` rows of the commonest length (of several, the longest); None without rows.

    Components whose deviation is rounding are left out, so that there are fewer than ``components`` where rows span less.
    """
    totals = written(in_arrow(rows.select("vec"), _totals, "size int, dim int, n long, high long, low long"), "totals")
    best = totals.where("dim = 0").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = totals.where(F.col("size") == best["size"]).groupBy("dim").agg(wide("high").alias("high"), wide("low").alias("low")).orderBy("dim").collect()  # one row a dimension
    sums = tuple((int(r.high) << 32) + int(r.low) for r in sums)
    sigma, v = jacobi(triangle(rows.where(F.size("vec") == best["size"]), best.n, sums))
    some = np.flatnonzero(sigma > len(sums) * np.finfo(float).eps * sigma[0])[:components]
    return Whitening(best.n, sums, v[:, some], sigma[some] ** 2 / best.n, float((sigma**2).sum()) / best.n)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None without components."""
    k = len(model.values)
    if not k:
        return None

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _matrices(batches):
            m = _moments(model.project(x))
            held = m if held is None else _merged_moments([held, m], k)
        if held is not None:
            yield _one(held)

    total = np.frombuffer(folded(in_arrow(rows.select("vec"), reduce, "at int, part binary"), lambda parts: _merged_moments(parts, k), "moments"))
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Entries become whole numbers floor(64 * c) + 1000000 first (beyond 2^62: 2^62). Rows whose vectors are null, empty
    or hold null or non-finite entries are dropped, and so are vectors of another length than the commonest. Repeated
    rows and equal vectors all count and are all returned; a null id stays null. Where all vectors are equal, or there
    is one row, or none, there is no component and so no row. ``deviation`` is null where it doesn't fit into 64 bits.
    Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df, id_col, vector_col)
    model = fit_whitening(rows, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == len(model.sums))
    error, k = identity_error(rows, model), len(model.values)
    explained = model.values / model.trace

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches):
            m = len(x)
            each = lambda a: a.take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                each(b.column("id")), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                each(pa.array(_deviations(x, model.n, model.sums), pa.int64())), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(rows, transform, schema)
