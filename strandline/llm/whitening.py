"""Whitening of vectors by a one-sided Jacobi SVD of what a blockwise TSQR leaves of them.

Components become whole numbers floor(1024 c) + 100000, so that sums are exact. Each task folds its centred rows, block by
block, into one triangle R; triangles are folded in groups of bounded size until one is left, whose columns plane rotations
make orthogonal. The rotations together are the components, the columns' lengths the standard deviations (times sqrt(n)): no
covariance is formed, so small ones keep their digits. What reaches the driver are sums and components, a few numbers for each
dimension, whatever the number of rows.

Vectors that are null, empty or hold null or non-finite components are dropped. Vectors of another length are a fit list of
their own. Rows with equal or null ids are kept, each for itself. Components without variance (one vector, equal vectors) have
no whitened value and no row. A component beyond 2**30 either way counts as that; a deviation beyond a long is null. Only the
id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored
from strandline.llm.vectors import usable

SCALE, SHIFT = 1024, 100_000
#: The largest component that is told apart.
LARGEST = 2.0**30
COMPONENTS = 8
#: Rows that are folded into a triangle at a time.
BLOCK_ROWS = 4096
#: Triangles are first dealt into so many groups, then these by so many, then all that are left meet.
FOLDS = (1024, 32)

_MOST = 2**62


def whole_numbers(c: np.ndarray) -> np.ndarray:
    """The exact long of each component."""
    return np.floor(SCALE * np.clip(c.astype(np.float64), -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a batch: which rows have it, and their whole numbers."""
    v = batch.column("v")
    sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, whole_numbers(flat[begins[rows][:, None] + np.arange(dim)])


def from_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: longs where they hold it, else Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < _MOST:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def squared_length(d: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond a long."""
    if d.dtype != object and (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < _MOST:
        return (d * d).sum(axis=1).tolist()
    return [total if (total := sum(int(z) ** 2 for z in row)) < 2**63 else None for row in d]


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, square: zero rows stand for those that are missing."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..d-1, in rounds of pairs that share no member."""
    ring = np.arange(d + d % 2)
    for _ in range(len(ring) - 1):
        a, b = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
        real = (a < d) & (b < d)
        yield a[real], b[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(r: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (a row each) of ``r``, by rotating pairs of its columns."""
    a, v = r.T.copy(), np.eye(r.shape[1])  # columns of r as rows
    small = 2 * np.finfo(float).eps
    for _ in range(most):
        turned = False
        for p, q in rounds(len(a)):
            pp, qq, pq = (a[p] ** 2).sum(axis=1), (a[q] ** 2).sum(axis=1), (a[p] * a[q]).sum(axis=1)
            on = np.abs(pq) > small * np.sqrt(pp * qq)
            if not on.any():
                continue
            turned = True
            p, q, pp, qq, pq = p[on], q[on], pp[on], qq[on], pq[on]
            zeta = (qq - pp) / (2 * pq)
            tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, tan)
            sin = cos * tan
            for m in (a, v):
                m[p], m[q] = cos[:, None] * m[p] - sin[:, None] * m[q], sin[:, None] * m[p] + cos[:, None] * m[q]
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=1)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[order]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, x in by_length(batch):
            n, total = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = n + len(x), total + x.sum(axis=0)
    for dim, (n, total) in held.items():
        yield pa.RecordBatch.from_pydict({"dim": [dim], "n": [n], "sums": [total.tolist()]}, pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


_TRIANGLES = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("r", pa.list_(pa.float64()))])


def _folded(held: dict[int, np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    for dim, r in held.items():
        yield pa.RecordBatch.from_pydict({"dim": [dim], "block": [block], "r": [r.ravel()]}, _TRIANGLES)


def _triangles(lists: dict[int, tuple[int, np.ndarray]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch):
                dim = x.shape[1]
                n, sums = lists[dim]
                for at in range(0, len(x), BLOCK_ROWS):
                    rows = (from_mean(x[at : at + BLOCK_ROWS], n, sums) / n).astype(np.float64)
                    held[dim] = triangle(np.vstack([held[dim], rows]) if dim in held else rows)
        yield from _folded(held, TaskContext.get().partitionId())

    return work


def _fold(group: pa.Table) -> pa.Table:
    dim = group.column("dim")[0].as_py()
    held = None
    for r in group.column("r"):
        rows = r.values.to_numpy().reshape(-1, dim)
        held = rows if held is None else triangle(np.vstack([held, rows]))
    return pa.Table.from_batches(_folded({dim: held}, group.column("block")[0].as_py()))


def _components(most: int):
    def work(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        lengths, axes = jacobi(_fold(group).column("r")[0].values.to_numpy().reshape(dim, dim))
        kept = np.flatnonzero(lengths > lengths[:1] * dim * np.finfo(float).eps)[:most]
        return pa.table(
            {"dim": [dim] * len(kept), "component": kept + 1, "length": lengths[kept], "total": [float((lengths**2).sum())] * len(kept), "axis": [axes[k] for k in kept]},
            pa.schema([("dim", pa.int32()), ("component", pa.int32()), ("length", pa.float64()), ("total", pa.float64()), ("axis", pa.list_(pa.float64()))]),
        )

    return work


class Fit:
    """What whitening needs of one length of vector: n, sums, components (a row each), standard deviations, explained shares."""

    def __init__(self, n: int, sums: np.ndarray, rows: list):
        rows = sorted(rows, key=lambda r: r.component)
        self.n, self.sums = n, sums
        self.axes = np.array([r.axis for r in rows]).reshape(len(rows), len(sums))
        self.deviations = np.array([r.length for r in rows]) / np.sqrt(n)
        self.explained = [r.length**2 / r.total for r in rows]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of the vectors ``v``; three levels of folding whatever the number of tasks."""
    totals = vectors.select("v").mapInArrow(_sums, "dim int, n long, sums array<long>")
    totals = totals.select("dim", "n", F.posexplode("sums").alias("pos", "s")).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = totals.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("sums")).collect()
    lists = {r.dim: (r.n, np.array([s.s for s in r.sums], np.int64)) for r in totals}
    kind = "dim int, block int, r array<double>"
    parts = vectors.select("v").mapInArrow(_triangles(lists), kind)
    for groups in FOLDS:
        parts = parts.withColumn("block", F.pmod("block", F.lit(groups))).groupBy("dim", "block").applyInArrow(_fold, kind)
    found = parts.groupBy("dim").applyInArrow(_components(components), "dim int, component int, length double, total double, axis array<double>").collect()
    return {dim: Fit(n, sums, [r for r in found if r.dim == dim]) for dim, (n, sums) in lists.items()}


def _whitened(fits: dict[int, Fit]):
    kind = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch):
                own = fits[x.shape[1]]
                d = from_mean(x, own.n, own.sums)
                w = (d / own.n).astype(np.float64) @ own.axes.T / own.deviations
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(pa.array(rows)), "dim": [x.shape[1]] * len(x), "deviation": squared_length(d), "w": list(w)}, kind)

    return work


def identity_errors(whitened: DataFrame, components: int = COMPONENTS) -> dict[int, float]:
    """By dim: the largest absolute entry of the covariance of ``w``, centred first, minus the identity."""
    w = [F.get("w", F.lit(i)) for i in range(components)]
    means = {r.dim: list(r)[1:] for r in whitened.groupBy("dim").agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(w))).collect()}
    centre = F.create_map(*(F.lit(z) for dim, m in means.items() for z in (dim, m))) if means else None
    if centre is None:
        return {}
    own = whitened.select("dim", *((x - F.get(centre[F.col("dim")], F.lit(i))).alias(f"c{i}") for i, x in enumerate(w)))
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    rows = own.groupBy("dim").agg(*(F.avg(F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs)).collect()
    return {r[0]: max((abs(c - (i == j)) for (i, j), c in zip(pairs, list(r)[1:]) if c is not None), default=0.0) for r in rows}


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, by falling variance: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    rows = vectors.select(vectors[f"`{vec_id}`"].cast("long").alias("vec_id"), vectors[f"`{vector}`"].alias("v")).filter(usable(F.col("v")))
    fits = fit(rows, components)
    done = stored(rows.mapInArrow(_whitened(fits), "vec_id long, dim int, deviation long, w array<double>"), "whitened")
    errors = identity_errors(done, components)
    facts = [(dim, k + 1, own.n, share, errors[dim]) for dim, own in fits.items() for k, share in enumerate(own.explained)]
    known = rows.sparkSession.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double")
    each = done.select("vec_id", "dim", "deviation", F.posexplode("w").alias("at", "whitened"))
    return (
        each.withColumn("component", F.col("at") + 1)
        .join(F.broadcast(known), ["dim", "component"])  # as many rows as components for each length of vector
        .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    )
