"""Equal contents: the first of each group is the original."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes hashed before whole contents are.
HEAD_BYTES = 1024


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, digest, original, copies) for contents that occur more than once; original is the smallest key.

    Contents that differ in size or head are told apart by those alone; only the rest is hashed whole. Groups are
    aggregates with map-side sums, so a content that many rows share moves as one row from each task.
    """
    sized = df.filter(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.octet_length(content).alias("size"), F.md5(F.substring(F.col(content).cast("binary"), 1, HEAD_BYTES)).alias("head"), F.col(content).alias("content"))
    shared = sized.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("size").alias("_s"), F.col("head").alias("_h"))
    hashed = sized.join(shared, (F.col("size") == F.col("_s")) & (F.col("head") == F.col("_h")), "left_semi").select("key", F.md5(F.col("content").cast("binary")).alias("digest"))
    groups = hashed.groupBy("digest").agg(F.min("key").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumnRenamed("digest", "_d")
    return hashed.join(groups, F.col("digest") == F.col("_d")).select(F.col("key").alias(key), "digest", "original", "copies")
