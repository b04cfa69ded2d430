"""What several operators of this subpackage need: scratch tables, components, small column helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker together. JVM and worker each hold some copies of a batch for every running task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of about ``BATCH_BYTES``, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. In local mode a folder of the driver's does where none is named."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_DIR)
    if context.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends if it wasn't before."""
    path = f"{scratch_dir(spark).rstrip('/')}/strandline-{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    remove = partial(where.getFileSystem(context._jsc.hadoopConfiguration()).delete, where, True)
    _folders[path] = remove
    if len(_folders) == 1:
        atexit.register(_remove_all)
    return path


_folders: dict[str, Callable[[], bool]] = {}


def _remove_all() -> None:
    while _folders:
        with suppress(Exception):  # the store or the JVM may be gone by now
            _folders.popitem()[1]()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that no later action reads: what was made of them is stored itself."""
    for table in tables:
        _folders.pop(table._stored)()


def row_keys(table: DataFrame, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """``table`` (with _id and _h first, any more columns after) renamed clear of ``docs``, and the test that a row is meant."""
    free = {c: c for c in table.columns}
    for c in table.columns:
        while free[c] in docs.columns:
            free[c] += "_"
    table = table.withColumnsRenamed(free)
    own = docs[f"`{doc_id}`"].cast("long")
    return table, own.eqNullSafe(table[free["_id"]]) & (F.xxhash64(docs[f"`{text}`"]) == table[free["_h"]])


def join_hot(left: DataFrame, right: DataFrame, key: str, salt: list[str], count: str) -> DataFrame:
    """``left`` joined with ``right`` (stored, a row for each key, ``count`` rows of ``left`` have it) where no task gets much more
    than a thousandth of all rows for one key.

    A key with more than that (a thousand keys at most, so they are broadcast) is dealt over shares: its rows of ``left`` by a hash
    of the columns ``salt``, its row of ``right`` to each. ``count`` is not returned.
    """
    least = max(1000, (right.agg(F.sum(count)).first()[0] or 0) // 1000)
    hot = stored(right.filter(F.col(count) > least).select(key, F.ceil(F.col(count) / least).cast("int").alias("_shares")), "hot")
    if hot.isEmpty():
        return left.join(right.drop(count), key)
    one, hot = F.coalesce("_shares", F.lit(1)), F.broadcast(hot)
    dealt = left.join(hot, key, "left").withColumn("_share", F.pmod(F.xxhash64(*salt), one).cast("int")).drop("_shares")
    copied = right.drop(count).join(hot, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), one - 1))).drop("_shares")
    return dealt.join(copied, [key, "_share"]).drop("_share")


def parts(rows: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` rows hold ``rows``."""
    return max(least, -(-rows // each))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its values (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def whole_group(table: pa.Table, name: str) -> pa.Array:
    """A table's column as one array."""
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has the columns a and b (long, any order, repeats and loops allowed). Returns one row (node,
    component) for each node that has an edge to another; component is the smallest node reachable. Each round is
    two joins on aggregated minima, so the star of a hot node is split like any skewed join. A round is stored and the
    one before it removed; rounds end when links no longer change.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("x2"), F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, F.col("x") == F.col("x2")).select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), "m")
        small = (
            large.join(lower, F.col("u") == F.col("u2"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        before, now = now, stored(small, "links")
        forget(before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def ascii_words(column: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+"))
