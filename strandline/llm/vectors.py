"""What the two vector searches share: usable vectors, blocks of vectors met by blocks of queries, the merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from strandline.llm.common import parts

#: Vectors in one block; each block is an index of its own.
BLOCK_ROWS = 2048
#: Vectors in one group of blocks, which one task searches block by block, keeping the best so far.
GROUP_ROWS = 16_384
#: Queries that meet a group at a time, at most.
QUERY_ROWS = 4096
#: Queries are not spread thinner than this to keep all cores busy.
LEAST_QUERIES = 64


def usable(vector: Column) -> Column:
    """Not null or empty, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def met(data: DataFrame, queries: DataFrame, key: str, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> tuple[GroupedData, GroupedData]:
    """Both tables (with a column dim) grouped so that every query meets every row of its dimension in one group.

    A row goes to one group by a hash of its key and is copied once for each lot of queries; a query (vec_id) is copied once
    for each group. Both are of bounded size.
    """
    groups, asked = parts(data.count(), group_rows), queries.count()
    spread = parts(2 * data.sparkSession.sparkContext.defaultParallelism, groups)
    lots = max(parts(asked, query_rows), min(spread, parts(asked, LEAST_QUERIES)))
    own = lambda name, n, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("*", own(key, groups, 1).alias("part"), every(lots).alias("lot"))
    right = queries.select("*", own("vec_id", lots, 2).alias("lot"), every(groups).alias("part"))
    keys = ("dim", "part", "lot")
    return left.groupBy(*keys), right.groupBy(*keys)


def search_groups(data: DataFrame, queries: DataFrame, search, k: int, score: str, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, vec_id, score): the k best of each query in each group of vectors.

    Both tables have vec_id and v (an array); only vectors of a query's dimension count.
    ``search(ids, vectors, query_ids, queries)`` returns arrays of query ids, vector ids and scores of one block.
    """
    sized = lambda df: df.select(F.size("v").alias("dim"), "vec_id", "v")
    left, right = met(sized(data), sized(queries), "vec_id", group_rows, query_rows)
    return left.cogroup(right).applyInArrow(_block_by_block(search, k, score, block_rows), f"query_id long, vec_id long, score {score}")


def distinct_rows(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` without those that no list of k can hold, with a number ``row`` for each.

    Equal vectors have equal scores, and of ties the smaller ids win: k + 1 ids of each vector are enough (one may be the
    query's own), and k copies of each id.
    """
    each = vectors.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    ranked = each.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return ranked.select("vec_id", "v", copy.alias("copy")).select("vec_id", "v", F.xxhash64("vec_id", "v", "copy").alias("row"))


def _block_by_block(search, k: int, score: str, block_rows: int):
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])

    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return kind.empty_table()
        (ids, x), (query_ids, q) = arrays(vectors), arrays(queries)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if score == "long" else np.float64))
        for block in np.array_split(np.arange(len(ids)), parts(len(ids), block_rows)):
            found = search(ids[block], x[block], query_ids, q)
            held = tuple(np.concatenate(z) for z in zip(held, found))
            sort = np.lexsort((held[1], -held[2], held[0]))
            held = tuple(z[sort] for z in held)
            top = np.arange(len(sort)) - np.searchsorted(held[0], held[0]) < k
            held = tuple(z[top] for z in held)
        return pa.table(list(held), schema=kind)

    return work


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (one a row) of a block, by id."""
    ids = table.column("vec_id").to_numpy()
    flat = pa.concat_arrays([x.flatten() for x in table.column("v").chunks]).to_numpy(zero_copy_only=False) if len(table) else np.zeros(0)
    sort = np.argsort(ids, kind="stable")
    return ids[sort], flat.reshape(len(ids), -1)[sort]


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, ties to the smaller id; adds rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_each(vectors: DataFrame) -> DataFrame:
    """Queries with one vector for each id: of several the smallest."""
    return vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def by_blocks(k: int):
    """A search for ``search_groups``: the k largest inner products in double precision, by comparing all."""

    def work(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, all_q: np.ndarray) -> tuple[np.ndarray, ...]:
        x, all_q = x.astype(np.float64), all_q.astype(np.float64)
        out = [(query_ids[:0], ids[:0], np.zeros(0))]
        for at in range(0, len(all_q), 256):
            q, own_ids = all_q[at : at + 256], query_ids[at : at + 256]
            score = q @ x.T
            score[ids[None, :] == own_ids[:, None]] = -np.inf
            most = min(k, len(ids))
            cut = -np.partition(-score, most - 1, axis=1)[:, most - 1 :][:, :1]
            with np.errstate(invalid="ignore"):
                rows, some = np.nonzero((score > -np.inf) & ((score >= cut - 1e-9 * (1 + np.abs(cut))) | (cut == -np.inf)))
            exact = np.einsum("pd,pd->p", q[rows], x[some])
            sort = np.lexsort((ids[some], -exact, rows))
            rows, some, exact = rows[sort], some[sort], exact[sort]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append((own_ids[rows[top]], ids[some[top]], exact[top]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    return work
