"""Approximate nearest neighbours by multiprobe p-stable hashing.

The index is several tables over all vectors. A table hashes a vector by its projections on normal random directions, cut
into slabs of equal width: a bucket is a combination of slabs. A query visits, in each table, its own bucket and perturbed
ones (some slabs one up or down) in the order in which they are likely to hold near vectors: by the sum of squares of the
distances from its projections to the slabs entered. Vectors and probes are shuffled by table and bucket and meet only
there; what the tables find is merged and ranked by exact inner product. Vectors are lengthened by one component to equal
norm first, so that the nearest by distance are those of the largest inner product; unit vectors stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import forget, parts, stored
from strandline.llm.vectors import best, by_blocks, distinct_rows, one_each, search_groups, usable

TABLES = 12
WIDTH = 3.0
#: Buckets that a query visits in each table.
PROBES = 200
SEED = 20
#: Vectors, and visits of queries, that meet in one group of buckets, about; larger groups are split.
LOT_ROWS, LOT_VISITS = 32_768, 32_768
_DEALT = 0x9E3779B97F4A7C15


class Hashes:
    """The hash functions of all tables, for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        random = np.random.default_rng([seed, dim])
        self.lines = random.standard_normal((tables, dim + 1, hashes))
        self.shift = random.random((tables, hashes))
        self.mix = random.integers(0, 1 << 62, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.width = width

    def places(self, table: int, x: np.ndarray) -> np.ndarray:
        """Of lengthened vectors, the place of each projection in slab units."""
        return x @ self.lines[table] / self.width + self.shift[table]

    def buckets(self, table: int, x: np.ndarray) -> np.ndarray:
        return _number(np.floor(self.places(table, x)).astype(np.int64).view(np.uint64) @ self.mix[table])


def _number(key: np.ndarray) -> np.ndarray:
    """A bucket's name as a 32-bit number (two buckets of one name are visited together)."""
    return (key * np.uint64(_DEALT) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def probes(place: np.ndarray, mix: np.ndarray, most: int) -> np.ndarray:
    """For each query the names of the ``most`` likeliest buckets, its own among them, by rising distance.

    A perturbation's cost is a sum over hashes, so the cheapest sets of the first hashes are all that the next one needs.
    """
    base = np.floor(place)
    key = base.astype(np.int64).view(np.uint64) @ mix
    part = place - base
    key, cost = key[:, None], np.zeros((len(place), 1))
    for k in range(place.shape[1]):
        down, up = np.square(part[:, k : k + 1]), np.square(1 - part[:, k : k + 1])
        cost = np.concatenate([cost, cost + down, cost + up], axis=1)
        key = np.concatenate([key, key - mix[k], key + mix[k]], axis=1)
        if cost.shape[1] > most:
            near = np.argpartition(cost, most - 1, axis=1)[:, :most]
            cost, key = np.take_along_axis(cost, near, 1), np.take_along_axis(key, near, 1)
    return _number(np.take_along_axis(key, np.argsort(cost, axis=1, kind="stable"), 1))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each dimension in a batch."""
    column = batch.column("v")
    size = column.value_lengths().to_numpy()
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def _lengthened(x: np.ndarray, largest: float) -> np.ndarray:
    unit = x / largest
    return np.hstack([unit, np.sqrt(np.maximum(0, 1 - np.square(unit).sum(axis=1)))[:, None]])


def _lot(bucket: np.ndarray, lots: int) -> np.ndarray:
    return (bucket.view(np.uint32).astype(np.int64) * lots) >> 32


def _placed(largest: float, lots: int, with_vectors: bool, *shape):
    """A row for each vector and table, with the vector or without."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch):
                hashes, x = Hashes(x.shape[1], *shape), _lengthened(x, largest)
                own = batch.take(pa.array(rows)).drop_columns(["v"]) if not with_vectors else batch.take(pa.array(rows))
                for t in range(shape[0]):
                    bucket = hashes.buckets(t, x)
                    every = [pa.array(np.full(len(rows), n, np.int32)) for n in (x.shape[1] - 1, t)]
                    yield pa.RecordBatch.from_arrays([*every, pa.array(_lot(bucket, lots).astype(np.int32)), pa.array(bucket), *own.columns], names=["dim", "tab", "lot", "bucket", *own.schema.names])

    return work


def _asked(most: int, lots: int, *shape):
    """For each query, table and lot the buckets to visit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q in _matrices(batch):
                hashes = Hashes(q.shape[1], *shape)
                q = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])
                for t in range(shape[0]):
                    for at in range(0, len(rows), 1024):
                        bucket = np.sort(probes(hashes.places(t, q[at : at + 1024]), hashes.mix[t], most).view(np.uint32), axis=1).view(np.int32)
                        lot = _lot(bucket, lots)
                        who, first = np.nonzero(np.hstack([np.ones((len(lot), 1), bool), lot[:, 1:] != lot[:, :-1]]))
                        begin = np.append(who * lot.shape[1] + first, lot.size).astype(np.int32)
                        own = batch.take(pa.array(rows[at : at + 1024][who]))
                        every = [pa.array(np.full(len(who), n, np.int32)) for n in (q.shape[1] - 1, t)]
                        lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(bucket.ravel()))
                        yield pa.RecordBatch.from_arrays([*every, pa.array(lot[who, first].astype(np.int32)), lists, own.column("vec_id"), own.column("v")], names=["dim", "tab", "lot", "buckets", "vec_id", "v"])

    return work


def _visited(k: int):
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def work(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return kind.empty_table()
        matrix = lambda table: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).astype(np.float64).reshape(len(table), -1)
        bucket = data.column("bucket").to_numpy()
        sort = np.argsort(bucket, kind="stable")
        bucket, x = bucket[sort], matrix(data)[sort]
        ids, row = data.column("vec_id").to_numpy()[sort], data.column("row").to_numpy()[sort]
        q, query_ids = matrix(queries), queries.column("vec_id").to_numpy()
        lists = queries.column("buckets")
        wanted = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks])
        end = np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in lists.chunks]))
        low, high = np.searchsorted(bucket, wanted, "left"), np.searchsorted(bucket, wanted, "right")
        out = []
        for n, (a, b) in enumerate(zip([0, *end[:-1].tolist()], end.tolist())):
            size = high[a:b] - low[a:b]
            total = int(size.sum())
            if not total:
                continue
            near = np.repeat(high[a:b] - np.cumsum(size), size) + np.arange(total)
            near = near[ids[near] != query_ids[n]]
            score = x[near] @ q[n]
            if len(near) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                near = near[score >= cut - 1e-9 * (1 + abs(cut))]
            exact = np.einsum("pd,d->p", x[near], q[n])  # alike for equal vectors, whatever the group
            near, exact = (z[np.lexsort((ids[near], -exact))[:k]] for z in (near, exact))
            out.append((np.full(len(near), query_ids[n]), ids[near], row[near], exact))
        return pa.table([np.concatenate(z) for z in zip(*out)], schema=kind) if out else kind.empty_table()

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, hashes: int | None = None, width: float = WIDTH, most: int = PROBES, seed: int = SEED, lot_rows: int = LOT_ROWS, lot_visits: int = LOT_VISITS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k largest inner products found, in double precision.

    Both tables have vec_id and v (array of float or double, usable, not zero). ``hashes`` of a table: by default one more
    than the binary logarithm of the number of vectors, so that buckets stay small as the table grows. Only vectors of a
    query's dimension count, and none with its id; equal rows count each; ties go to the smaller id. A query that found
    fewer than k is compared with all vectors, in blocks, so fewer than k candidates are all returned. Empty tables give an
    empty table.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    total, largest = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    lots, largest = parts(total, lot_rows), largest or 1.0
    shape = tables, hashes or max(4, total.bit_length()), width, seed
    data = stored(distinct_rows(vectors, k), "vectors")
    place, kind = "dim int, tab int, lot int", data.schema["v"].dataType.simpleString()
    asked = stored(queries.select("vec_id", "v").mapInArrow(_asked(most, lots, *shape), f"{place}, buckets array<int>, vec_id long, v {kind}"), "probes")
    keys = ["dim", "tab", "lot"]
    held = data.mapInArrow(_placed(largest, lots, False, *shape), f"{place}, bucket int, vec_id long, row long").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("visits"))
    came = asked.groupBy(*keys).agg(F.lit(0).cast("long").alias("rows"), F.count(F.lit(1)).alias("visits"))
    sizes = held.union(came).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("visits").alias("visits"))
    full = sizes.select(*keys, *[F.ceil(F.col(c) / most_).cast("int").alias(name) for c, most_, name in (("rows", 2 * lot_rows, "across"), ("visits", 2 * lot_visits, "down"))])
    full = stored(full.filter("across > 1 or down > 1"), "full")
    placed = data.mapInArrow(_placed(largest, lots, True, *shape), f"{place}, bucket int, vec_id long, v {kind}, row long")
    visits = asked
    one = F.lit(0).alias("a"), F.lit(0).alias("d")
    if full.limit(1).count():  # groups over twice the size: a grid of parts, each vector in a row and each query in a column
        part = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        across, down = F.coalesce(F.greatest("across", F.lit(1)), F.lit(1)), F.coalesce(F.greatest("down", F.lit(1)), F.lit(1))
        placed = placed.join(full, keys, "left").select(*placed.columns, part(1, across).alias("a"), every(down).alias("d"))
        visits = visits.join(full, keys, "left").select(*visits.columns, every(across).alias("a"), part(2, down).alias("d"))
    else:
        placed, visits = placed.select("*", *one), visits.select("*", *one)
    keys = [*keys, "a", "d"]
    met = placed.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_visited(k), "query_id long, vec_id long, row long, score double")
    found = stored(best(met.dropDuplicates(["query_id", "vec_id", "row"]), k), "found")
    forget(asked)
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("_q"))
    short = stored(queries.join(enough, F.col("vec_id") == F.col("_q"), "left_anti"), "short")
    if not short.limit(1).count():
        return found
    again = search_groups(vectors, short, by_blocks(k), k, "double")
    return found.join(enough, F.col("query_id") == F.col("_q"), "left_semi").union(best(again, k))


def candidates(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Rows (vec_id, v), floats as floats and all else in double precision. Unusable and zero vectors and null ids stay out."""
    own = table.filter(usable(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(vec_id).isNotNull())
    kind = table.schema[vector].dataType.simpleString()
    return own.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))


def search_every(table: DataFrame, nth: int = 20, k: int = 20) -> DataFrame:
    """``nearest`` with the rows whose id is divisible by ``nth`` as queries against all rows."""
    vectors = candidates(table)
    return nearest(vectors, one_each(vectors.filter(F.col("vec_id") % nth == 0)), k)
