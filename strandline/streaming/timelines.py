"""Timelines, duplicates and counts over streams of events."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.storage import new_folder, remover


def sessions(events: DataFrame, key: str, when: str, lasts: str, late: str = "1 hour") -> DataFrame:
    """Rows (key, start, end, n): events that last for ``lasts``, merged where they overlap, each final once ``late`` has passed.

    ``when`` is a timestamp. Unlike the batch timelines, intervals that only touch stay apart.
    """
    spans = events.withWatermark(when, late).groupBy(key, F.session_window(when, lasts))
    return spans.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(rows: DataFrame, content: str, when: str, within: str = "1 hour") -> DataFrame:
    """Rows whose content has not been seen within the last while."""
    return first_within(rows.withColumn("_digest", F.sha2(F.col(content), 256)), ["_digest"], when, within).drop("_digest")


def first_within(rows: DataFrame, keys: Sequence[str], when: str, within: str = "1 hour") -> DataFrame:
    """One row of those that are equal in ``keys`` and less than ``within`` apart in time.

    A key is forgotten once the latest time seen is more than ``within`` later than that of its row, so state holds the keys of
    that while only. Rows further behind the latest time that the batches before the last have seen are dropped.
    """
    return rows.withWatermark(when, within).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, when: str, kind: str, value: str, width: str = "1 hour", late: str = "1 hour", aggregates: Sequence[Column] | None = None) -> DataFrame:
    """By kind in windows of time: n and total of the value, or other aggregates.

    In append mode a window comes out once, when the latest time seen is ``late`` past its end, and leaves the state. Rows of
    windows that were over before the last batch are dropped.
    """
    windows = events.withWatermark(when, late).groupBy(F.window(when, width), kind)
    found = windows.agg(*(aggregates or [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")]))
    return found.select(F.col("window.start").alias("start"), kind, *found.columns[2:])


def drained(stream: DataFrame, where: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that its source holds now. Its state and its batches are kept in the folder ``where``.

    A run that was stopped goes on there, with another process too: a batch that is made again replaces what was written of
    it. In complete mode the last batch is the result, and those before it go.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batches/{number}")
        if mode == "complete" and number:
            remover(spark, f"{where}/batches/{number - 1}")()

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(keep).start()
    query.awaitTermination()
    return query


def results(spark: SparkSession, where: str, schema) -> DataFrame:
    """The rows that streams drained into ``where`` have given so far."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{where}/batches")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(f.getPath()) for f in files.listStatus(path)] if files.exists(path) else []
    found = [f for f in found if re.search(r"/\d+$", f)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream's result is once all that its source holds now is read, as a table. A source without rows gives an empty
    table; the stream's folder goes when the driver ends."""
    where = new_folder(stream.sparkSession, "stream")
    drained(stream, where, mode)
    return results(stream.sparkSession, where, stream.schema)
