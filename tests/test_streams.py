"""Streams in many small batches: results, bounded state, late rows, restarts."""

import os
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import storage
from strandline.plans import stream_queries
from strandline.plans.registry import ORACLE_SQL
from strandline.streaming import mentions, timelines

EVENTS = "/root/testdata/sf0.001/events.parquet"
SCHEMA = "event_id long, user_id long, event_type string, value double, at timestamp"


def _write(folder, name, rows, second):
    """A file of rows; ``second`` says when it was written, as streams read files in that order."""
    path = folder / f"{name}.parquet"
    frame = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value", "at"])
    frame = frame.astype({"event_id": "Int64", "user_id": "Int64"})
    frame["at"] = pd.to_datetime(frame["at"]).astype("datetime64[us]").dt.tz_localize("UTC")
    frame.to_parquet(path)
    os.utime(path, (1_700_000_000 + second,) * 2)


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def by_day(tmp_path):
    """Events of a table, a file a day: the folder, the files' rows in order."""
    rows = duckdb.sql(f"SELECT event_id, user_id, event_type, value, ts FROM '{EVENTS}' ORDER BY ts").fetchall()
    days = {}
    for r in rows:
        days.setdefault(r[4].date(), []).append(r)
    return tmp_path, [days[d] for d in sorted(days)]


def _state(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def _sql(name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{EVENTS}'")
    return sorted(con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.fixture
def rocks(spark):
    spark.conf.set(mentions.STORE, mentions.ROCKS)
    yield
    spark.conf.unset(mentions.STORE)


def test_closed_windows_leave_the_state(spark, by_day, tmp_path_factory):
    folder, days = by_day
    for k, rows in enumerate(days[:8]):
        _write(folder, f"d{k}", rows, k)
    where = str(tmp_path_factory.mktemp("w"))
    counted = timelines.windowed_counts(_stream(spark, folder), "at", "event_type", "value")
    query = timelines.drained(counted, where)
    found = timelines.results(spark, where, counted.schema)
    last = max(r[4] for r in days[7])
    want = {}
    for r in (r for d in days[:8] for r in d):
        start = r[4].replace(minute=0, second=0, microsecond=0)
        if start + timedelta(hours=2) <= last:
            want[start, r[2]] = want.get((start, r[2]), 0) + 1
    assert {(r.start, r.event_type): r.n for r in found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n").collect()} == want
    assert found.count() == len(want)
    assert max(_state(query)) <= 26 * 5 and _state(query)[-1] <= 3 * 5  # a day and an hour of windows; at the end what isn't over


def test_each_key_once_within_the_watermark(spark, by_day, tmp_path_factory):
    folder, days = by_day
    for k, rows in enumerate(days[:8]):
        half = len(rows) // 2
        _write(folder, f"d{k}a", rows[half:], 2 * k)  # a day's later half comes first
        _write(folder, f"d{k}b", rows[:half], 2 * k + 1)
    where = str(tmp_path_factory.mktemp("w"))
    daily = timelines.first_within(_stream(spark, folder).withColumn("day", F.to_date("at")), ["user_id", "day"], "at", "1 day").select("user_id", "day")
    query = timelines.drained(daily, where)
    want = sorted({(r[1], r[4].date()) for d in days[:8] for r in d})
    assert sorted(map(tuple, timelines.results(spark, where, daily.schema).collect())) == want
    assert max(_state(query)) < len(want) / 2


def test_late_rows_are_dropped(spark, tmp_path, tmp_path_factory):
    at = datetime(2024, 1, 1)
    _write(tmp_path, "a", [(1, 1, "x", 1.0, at + timedelta(hours=5))], 0)
    _write(tmp_path, "b", [(2, 1, "x", 1.0, at + timedelta(hours=4, minutes=30))], 1)
    _write(tmp_path, "c", [(3, 1, "x", 1.0, at + timedelta(minutes=30)), (4, 1, "x", 1.0, at + timedelta(hours=4, minutes=40))], 2)
    _write(tmp_path, "d", [(5, 1, "x", 1.0, at + timedelta(hours=9))], 3)
    where = str(tmp_path_factory.mktemp("w"))
    counted = timelines.windowed_counts(_stream(spark, tmp_path), "at", "event_type", "value")
    query = timelines.drained(counted, where)
    rows = timelines.results(spark, where, counted.schema).orderBy("start").collect()
    assert [(r.start.hour, r.n) for r in rows] == [(4, 2), (5, 1)]  # the row of 00:30 came after that hour was over
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress) == 1


def test_second_mentions_survive_a_restart(spark, by_day, tmp_path_factory, rocks):
    folder, days = by_day
    where = str(tmp_path_factory.mktemp("w"))
    run = lambda: timelines.drained(found, where)
    found = mentions.second_mentions(_stream(spark, folder), ["user_id", "event_type"], "at", "event_id")
    for k, rows in enumerate(days[:4]):
        _write(folder, f"d{k}", rows, k)
    run()
    some = timelines.results(spark, where, found.schema).count()
    _write(folder, "rest", [r for d in days[4:] for r in d], 100)
    found = mentions.second_mentions(_stream(spark, folder), ["user_id", "event_type"], "at", "event_id")
    query = run()
    rows = timelines.results(spark, where, found.schema).withColumn("second_at", F.col("second_at").cast("timestamp_ntz"))
    assert sorted(map(tuple, rows.collect())) == _sql("stream_second_mentions", "user_id, event_type, first_id, second_id, second_at")
    assert 0 < some < rows.count()
    keys = len({(r[1], r[2]) for d in days for r in d})
    assert keys <= max(_state(query)) <= 3 * keys  # one row and at most a timer (held twice) for each key


def test_second_mentions_in_any_order(spark, tmp_path, tmp_path_factory, rocks):
    at = datetime(2024, 1, 1)
    h = lambda n: at + timedelta(hours=n)
    _write(tmp_path, "a", [(3, 1, "x", 1.0, h(2)), (1, 1, "x", 1.0, h(1)), (1, 1, "x", 1.0, h(1)), (9, 2, "x", 1.0, h(1))], 0)
    _write(tmp_path, "b", [(2, 1, "x", 1.0, h(1.5)), (8, None, "x", 1.0, h(1))], 1)  # an earlier second, in time
    _write(tmp_path, "c", [(4, 1, "x", 1.0, h(30)), (5, 3, "x", 1.0, h(60))], 2)
    _write(tmp_path, "d", [(11, 3, "x", 1.0, h(70))], 3)
    _write(tmp_path, "e", [(12, 3, "x", 1.0, h(71))], 4)
    _write(tmp_path, "f", [(6, 1, "x", 1.0, h(72)), (7, 1, "x", 1.0, h(73))], 5)
    _write(tmp_path, "g", [(10, 4, "x", 1.0, h(99))], 6)
    where = str(tmp_path_factory.mktemp("w"))
    found = mentions.second_mentions(_stream(spark, tmp_path), ["user_id"], "at", "event_id", forget_ms=40 * 3_600_000)
    timelines.drained(found, where)
    rows = timelines.results(spark, where, found.schema).orderBy("second_at").collect()
    assert [(r.user_id, r.first_id, r.second_id) for r in rows] == [(1, 1, 2), (3, 5, 11), (1, 6, 7)]  # forgotten after 40 hours, then anew


def test_empty_streams_and_folders(spark, tmp_path):
    empty = timelines.finished(timelines.first_of_each(_stream(spark, tmp_path), "event_type", "at"), "append")
    assert empty.collect() == [] and "event_type" in empty.columns
    kept = storage.ended(spark.range(3))
    path = kept._stored
    assert kept.count() == 3 and os.path.isdir(path)
    storage.forget(kept)
    assert not os.path.exists(path)


def test_registered_streams_read_tables(spark):
    assert stream_queries.stream_daily_users(spark, "/root/testdata/sf0.001").count() > 0
