"""Streams over a table's files, read until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.registry import query, table
from strandline.streaming import mentions, timelines


def _events(spark, sf_dir):
    """``events`` as a stream, whether it is a file or a folder (a pattern stands for either); times of the session's zone."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_counts_by_hour(spark, sf_dir):
    counted = timelines.windowed_counts(_events(spark, sf_dir), "at", "event_type", "value", aggregates=[F.count(F.lit(1)).alias("n"), F.max("value").alias("most")])
    return timelines.finished(counted).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "most")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval 12 hours THEN 0 ELSE 1 END AS is_new FROM events WHERE ts IS NOT NULL),
    numbered AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT user_id, min(ts) AS start, max(ts) + interval 12 hours AS "end", count(*) AS n FROM numbered GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    found = timelines.finished(timelines.sessions(_events(spark, sf_dir), "user_id", "at", "12 hours"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_closed_hours(spark, sf_dir):
    """Hours that are over, each once; state holds those that aren't."""
    counted = timelines.windowed_counts(_events(spark, sf_dir), "at", "event_type", "value", aggregates=[F.count(F.lit(1)).alias("n"), F.max("value").alias("most")])
    return timelines.finished(counted, "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "most")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval 12 hours THEN 0 ELSE 1 END AS is_new FROM events WHERE ts IS NOT NULL),
    numbered AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT user_id, min(ts) AS start, max(ts) + interval 12 hours AS "end", count(*) AS n FROM numbered GROUP BY user_id, k HAVING max(ts) + interval 12 hours <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_closed_sessions(spark, sf_dir):
    found = timelines.finished(timelines.sessions(_events(spark, sf_dir), "user_id", "at", "12 hours"), "append")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL")
def stream_daily_users(spark, sf_dir):
    """Each user once a day: rows of one day are less than a day apart, and a key is forgotten a day later."""
    days = _events(spark, sf_dir).filter("at IS NOT NULL").select("user_id", "at", F.to_date("at").alias("day"))
    return timelines.finished(timelines.first_within(days, ["user_id", "day"], "at", "1 day"), "append").select("user_id", "day")


@query("""WITH r AS (SELECT *, row_number() OVER w AS k, lag(event_id) OVER w AS first_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type, first_id, event_id AS second_id, ts AS second_at FROM r WHERE k = 2 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_second_mentions(spark, sf_dir):
    """Each user's second event of a kind, once an hour has passed since; state by lots of users and kinds, with timeouts."""
    before = spark.conf.get(mentions.STORE, None)
    spark.conf.set(mentions.STORE, mentions.ROCKS)
    try:
        found = timelines.finished(mentions.second_mentions(_events(spark, sf_dir), ["user_id", "event_type"], "at", "event_id"), "append")
    finally:
        spark.conf.set(mentions.STORE, before) if before else spark.conf.unset(mentions.STORE)
    return found.withColumn("second_at", F.col("second_at").cast("timestamp_ntz"))
