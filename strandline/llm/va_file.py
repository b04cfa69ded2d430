"""Exact top-k by inner product over a vector-approximation file.

The file is a Parquet table in which every vector is kept as cell numbers of ``bits`` bits: each dimension's range is cut
into 2**bits cells of equal width. A query scans the cells for bounds of each vector's score. Exact vectors are then read in
order of their upper bound (the lower bound of distance): first a lot of the best ones, whose kth exact score is a limit, and
then just those whose bound isn't below that limit, so that the kth result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import forget, stored
from strandline.llm.vectors import GROUP_ROWS, QUERY_ROWS, best, distinct_rows, met, one_each, usable

BITS = 6
SCALE = 256
#: Exact vectors in the first lot of a query, in units of k.
FIRST = 4
#: Queries whose bounds are held at a time.
_SOME = 256


def approximation(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Cell numbers of integer vectors."""
    return ((x - low) // width).astype(np.uint8)


def cell_scores(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query and vector the score of the vector's cells' least corner, and for each query how far an exact score
    may be under and over that. Only the corner depends on the vector, so a scan is one product with cell numbers."""
    q, width = q.astype(np.float64), width.astype(np.float64)
    corner = (q * width) @ cells.astype(np.float64).T + (q @ low.astype(np.float64))[:, None]
    reach = np.abs(q) @ (np.abs(low) + 256 * width) * 1e-12  # rounding
    return corner, np.minimum(q, 0) @ (width - 1) - reach, np.maximum(q, 0) @ (width - 1) + reach


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, _, x in _by_dim(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["dim", "place", "low", "high"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    column = batch.column("v")
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        rows = pa.array(np.flatnonzero(size == dim))
        yield dim, rows, column.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _quantised(cut: dict[int, tuple[np.ndarray, np.ndarray]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                cells = approximation(x, *cut[dim])
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
                every = pa.array(np.full(len(x), dim, np.int32))
                yield pa.RecordBatch.from_arrays([every, batch.column("vec_id").take(rows), batch.column("row").take(rows), column], names=["dim", "vec_id", "row", "cells"])

    return work


def _scanned(k: int, cut: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Of one group, for each query the vectors that can be among its k best there: with their bounds."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])

    def work(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return kind.empty_table()
        dim = data.column("dim")[0].as_py()
        flat = lambda column: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
        cells = np.frombuffer(b"".join(data.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
        ids, row, query_ids = data.column("vec_id").to_numpy(), data.column("row").to_numpy(), queries.column("vec_id").to_numpy()
        q, out = flat(queries.column("v")).astype(np.int64).reshape(-1, dim), []
        for at in range(0, len(q), _SOME):
            corner, under, over = cell_scores(q[at : at + _SOME], cells, *cut[dim])
            corner[query_ids[at : at + _SOME, None] == ids] = -np.inf
            last = min(k, len(ids)) - 1
            kth = -np.partition(-corner, last, axis=1)[:, last]
            who, near = np.nonzero((corner > -np.inf) & (corner + over[:, None] >= (kth + under)[:, None]))
            found = corner[who, near]
            out.append((query_ids[at : at + _SOME][who], ids[near], row[near], found + under[who], found + over[who]))
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=kind)

    return work


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = BITS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k highest integer inner products.

    Both tables have vec_id and v (array of integers, not null, without nulls). Only vectors of a query's dimension count,
    and none with its id; equal rows count each; ties go to the smaller id. Fewer candidates than k: all of them. Scores
    are 64-bit sums, so components should stay under 2**28 in size. Empty tables give an empty table. The driver holds the
    ends of each dimension's range, as many as a vector has components.
    """
    data = stored(distinct_rows(vectors, k), "vectors")
    ends = data.mapInArrow(_extremes, "dim int, place int, low long, high long").groupBy("dim", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, own in ends.toPandas().groupby("dim"):
        own = own.sort_values("place")
        low, high = own["low"].to_numpy(), own["high"].to_numpy()
        cut[int(dim)] = low, np.maximum(1, -(-(high - low + 1) >> bits))
    file = stored(data.mapInArrow(_quantised(cut), "dim int, vec_id long, row long, cells binary"), "cells")
    asked = queries.select(F.size("v").alias("dim"), "vec_id", "v")
    left, right = met(file, asked, "row", group_rows, query_rows)
    bounds = stored(left.cogroup(right).applyInArrow(_scanned(k, cut), "query_id long, vec_id long, row long, least double, most double"), "bounds")
    forget(file)
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id", "row")
    bounds = bounds.withColumn("place", F.row_number().over(order))
    named = queries.select(F.col("vec_id").alias("_q"), F.col("v").alias("_v"))
    exact = data.select(F.col("row").alias("_row"), "v")

    def read(some: DataFrame) -> DataFrame:
        met_ = some.join(exact, F.col("row") == F.col("_row")).join(named, F.col("query_id") == F.col("_q"))
        score = F.aggregate(F.zip_with("v", "_v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return met_.select("query_id", "vec_id", score.alias("score"))

    first = stored(read(bounds.filter(F.col("place") <= FIRST * k)), "first")
    limit = best(first, k).groupBy("query_id").agg(F.min("score").alias("limit"), F.count(F.lit(1)).alias("n"))
    limit = limit.filter(F.col("n") == k).select(F.col("query_id").alias("_q"), "limit")
    rest = bounds.filter(F.col("place") > FIRST * k).join(limit, F.col("query_id") == F.col("_q"), "left").filter("limit is null or most >= limit")
    return best(first.union(read(rest.select("query_id", "vec_id", "row"))), k)


def scaled(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Rows (vec_id, v): each component x as floor(256 * x). Unusable vectors and null ids stay out."""
    own = table.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    return own.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def search_every(table: DataFrame, nth: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` with the rows whose id is divisible by ``nth`` as queries against all rows."""
    vectors = scaled(table)
    return top_k(vectors, one_each(vectors.filter(F.col("vec_id") % nth == 0)), k)
