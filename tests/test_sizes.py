"""What queries do on tables larger, or of other values, than those at hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import convert, rounding, strings
from strandline.plans import catalog
from strandline.streaming import mentions, timelines

TABLES = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["labelled_lines", "csv_blocks"])
def test_lines_meet_their_text_without_a_join(spark, name):
    """Files of repeated values are small for their rows, so that joins on them were taken for small and broadcast."""
    assert "Join" not in _plan(catalog.QUERIES[name](spark, TABLES))


def test_lines_of_texts_with_parts_missing(spark):
    texts = spark.createDataFrame([(1, "x\nName: a\n  B: 1\nKey: k\nEnd\nName: b"), (2, "Key: z\n  B: 1\nno"), (3, "Name: c\nEnd"), (None, "Name: d\n  B: 1\nKey: y")], "id int, text string")
    lines = strings.lines_of(texts, "id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(strings.first_following(lines.filter("id > 0"), "id", "Name:")) == [(1, "a"), (3, "c")]
    assert rows(strings.relative_line(lines.filter("id > 0"), "id", "  B:", 1, "Key:")) == [(1, "k")]
    assert rows(strings.lines_between(lines, "id", "Name:", ["End"])) == [(1, 1, "Name: a"), (1, 2, "  B: 1"), (1, 3, "Key: k"), (3, 0, "Name: c")]


def _against_sql(spark, folder, name, table, rows, schema):
    """Both results as texts, in which zeros have signs."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_logarithms_that_are_halves_once_scaled(spark, tmp_path):
    """Of these prices the logarithm times 10**9 is a half in binary, though its decimals are below one."""
    prices = [119649.31, 142513.29, 278374.36, 394952.25, 1000.0, 500000.0]
    _against_sql(spark, tmp_path, "logarithms_and_counts", "orders", list(enumerate(prices)), "o_orderkey long, o_totalprice double")


def test_logits_just_below_zero(spark, tmp_path):
    values = [49.999999, 50.0, 50.000001, 0.0, 100.0, -1.0, 101.0, None, -5000.0, 5000.0, 33.3, 67.07]
    _against_sql(spark, tmp_path, "logistic", "events", list(enumerate(values)), "event_id long, value double")


def test_rounding_scaled(spark):
    xs = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 4503599627370495.5, 1e300, -1e300, 1.7e308, float("inf"), float("-inf"), 11.692320326499999, -4e-10, 1.005, None]
    con = duckdb.connect()
    for n in (0, 2, 9):
        got = [r[1] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", rounding.round_scaled(F.col("x"), n)).orderBy("i").collect()]
        assert list(map(repr, got)) == [repr(con.execute(f"SELECT round(CAST(? AS DOUBLE), {n})", [x]).fetchone()[0]) for x in xs]


def test_a_drawn_number_is_made_once(spark):
    """Checks named their number some twenty times, and each of these made forty draws anew."""
    number = convert.random_nhs(F.col("id"))
    checked = spark.range(300).select(convert.is_valid_nhs(number).alias("valid"), convert.is_test_nhs(number).alias("is_test"))
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 2
    assert checked.filter("valid AND is_test").count() == 300


def test_second_mentions_have_a_state_a_lot(spark, tmp_path, monkeypatch):
    """Keys were a call of Python each and several of the state store."""
    monkeypatch.setattr(mentions, "LOTS", 4)
    events = spark.readStream.schema(spark.read.parquet(f"{TABLES}/events.parquet").schema).parquet(f"{TABLES}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    found = mentions.second_mentions(events, ["user_id", "event_type"], "at", "event_id")
    query = timelines.drained(found, str(tmp_path))
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{TABLES}/events.parquet'")
    rows = timelines.results(spark, str(tmp_path), found.schema).withColumn("second_at", F.col("second_at").cast("timestamp_ntz"))
    assert sorted(map(tuple, rows.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL['stream_second_mentions']})").fetchall())
