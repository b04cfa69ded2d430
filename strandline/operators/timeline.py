"""Timelines from events that last for a fixed time, and cumulative time on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.intervals import coalesce, whole_seconds


def timelines(events: DataFrame, key: str, when: str, lasts: Column) -> DataFrame:
    """Merged intervals [when, when + lasts] of each key: rows (key, start, end, n)."""
    spans = events.filter(F.col(key).isNotNull() & F.col(when).isNotNull()).select(key, F.col(when).alias("start"), (F.col(when) + lasts).alias("end"))
    return coalesce(spans, [key])


def cumulative_time(events: DataFrame, queries: DataFrame, key: str, when: str, lasts: Column, start: str = "start", at: str = "when", clip: bool = False) -> DataFrame:
    """Time before, during and after for each query row (key, start, when), in days rounded down and in seconds.

    With e the first start of the key's timeline: a query at or before its own start gets nothing; one at or before e, or
    of a key without events, is all *before*. Else *before* is what lies between start and e, *during* is covered time up
    to the query, *after* the rest since e. Covered time ahead of the query's start counts unless ``clip``.
    """
    line = timelines(events, key, when, lasts).select(F.col(key).alias("_key"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    asked = queries.select(key, F.col(start).alias("start"), F.col(at).alias("when")).distinct()
    met = asked.join(line, asked[key] == line["_key"], "left")
    begin = F.greatest("_from", "start") if clip else F.col("_from")
    part = F.when(F.col("_from") < F.col("when"), F.greatest(whole_seconds(begin, F.least("_to", "when")), F.lit(0))).otherwise(0)
    sums = met.groupBy(key, "start", "when").agg(F.min("_from").alias("_first"), F.sum(part).alias("_during"))
    none = F.col("when") <= F.col("start")
    ahead = F.col("_first").isNull() | (F.col("when") <= F.col("_first"))
    before = F.when(none, 0).when(ahead, whole_seconds("start", "when")).otherwise(F.greatest(whole_seconds("start", "_first"), F.lit(0)))
    during = F.when(none | ahead, 0).otherwise(F.col("_during"))
    after = F.when(none | ahead, 0).otherwise(whole_seconds("_first", "when") - F.col("_during"))
    out = sums.select(key, "start", "when", before.cast("long").alias("before_seconds"), during.cast("long").alias("during_seconds"), after.cast("long").alias("after_seconds"))
    day = lambda c: F.floor(F.col(f"{c}_seconds") / 86400).cast("long").alias(f"{c}_days")
    return out.select("*", day("before"), day("during"), day("after"))
