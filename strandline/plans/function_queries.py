"""Queries in SQL that use the library's table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dates, expressions, hashing, strings, tables
from strandline.plans.registry import query, table


@query("""WITH e AS (SELECT user_id, ts AS begins, ts + INTERVAL 20 HOUR AS ends FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    m AS (SELECT *, CASE WHEN begins <= max(ends) OVER (PARTITION BY user_id ORDER BY begins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM e),
    g AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY begins ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id AS key, min(begins) AS begins, max(ends) AS ends, count(*) AS n FROM g GROUP BY user_id, k""")
def table_function_intervals(spark, sf_dir):
    """Intervals merged by a function over a table, by user and in order."""
    tables.register(spark)
    events = table(spark, sf_dir, "events")
    return spark.sql("""SELECT * FROM merged_intervals(TABLE(SELECT user_id, ts AS begins, ts + INTERVAL 20 HOURS AS ends FROM {events} WHERE user_id IS NOT NULL) PARTITION BY user_id ORDER BY begins)""", events=events)


@query("""WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS b, o_orderdate + INTERVAL 5 HOUR + to_hours(o_orderkey % 60) AS e FROM orders),
    d AS (SELECT o_orderkey, b, e, unnest(generate_series(CAST(b AS DATE), CAST(e AS DATE), INTERVAL 1 DAY)) AS day FROM o WHERE b < e)
    SELECT o_orderkey, CAST(day AS DATE) AS day, round(epoch(least(e, day + INTERVAL 1 DAY) - greatest(b, day)) / 3600, 6) AS hours, CAST(isodow(day) AS INTEGER) AS weekday FROM d WHERE day < e""")
def table_function_days(spark, sf_dir):
    """The days each interval touches, joined laterally."""
    tables.register(spark)
    orders = table(spark, sf_dir, "orders")
    return spark.sql("""SELECT o_orderkey, day, round(hours, 6) AS hours, weekday FROM (SELECT o_orderkey, o_orderdate + INTERVAL 5 HOURS AS b, o_orderdate + INTERVAL 5 HOURS + make_dt_interval(0, CAST(o_orderkey % 60 AS INT)) AS e FROM {orders}),
        LATERAL interval_days(b, e)""", orders=orders)


@query("""SELECT c_custkey, CAST(2 AS INTEGER) AS line, CAST(k AS INTEGER) AS place, ['name', 'note'][k + 1] AS name, [c_name, 'a,"' || c_nationkey || '"'][k + 1] AS value FROM customer, (VALUES (0), (1)) t(k)""")
def table_function_blocks(spark, sf_dir):
    """Comma-separated blocks inside texts."""
    tables.register(spark)
    text = """concat_ws(chr(10), 'before,x', 'name,note', concat(c_name, ',"a,""', c_nationkey, '""\"'), '', 'after,y')"""
    return spark.sql(f"SELECT c_custkey, line, place, name, value FROM (SELECT c_custkey, {text} AS text FROM {{customer}}), LATERAL csv_block(text, 'name,note')", customer=table(spark, sf_dir, "customer"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CAST(DATE '2024-03-01' + CAST(c_custkey % 27 AS INTEGER) - CAST(c_custkey % 27 AS INTEGER) AS DATE) AS month,
    CAST(2020 - 1980 - CASE WHEN c_custkey % 300 > 165 THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(greatest(10 - c_custkey % 20, 0) AS INTEGER) AS shared, round(CASE WHEN c_custkey % 10 > 0 THEN ln((c_custkey % 10) / 10.0 / (1 - (c_custkey % 10) / 10.0)) END, 9) AS odds FROM customer""")
def sql_functions(spark, sf_dir):
    """Functions written in SQL."""
    tables.register(spark)
    return spark.sql("""SELECT c_custkey, blank_to_null(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END) AS name, first_of_month(date_add(DATE'2024-03-01', CAST(c_custkey % 27 AS INT))) AS month,
        age_at(date_add(DATE'1980-01-01', CAST(c_custkey % 300 AS INT)), DATE'2020-06-14') AS age, overlap_days(DATE'2024-01-01', DATE'2024-01-11', date_add(DATE'2024-01-01', CAST(c_custkey % 20 AS INT)), DATE'2024-03-01') AS shared,
        round(logit((c_custkey % 10) / 10D), 9) AS odds FROM {customer}""", customer=table(spark, sf_dir, "customer"))


@query("""WITH c AS (SELECT c_custkey, c_custkey + 100000 AS id, c_name, c_nationkey, c_acctbal FROM customer)
    SELECT c_custkey AS id, id || ' |' || c_name || '| + ' || (id + 7) || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE ' : 363698007 |Finding site| = "a \\"' || c_name || '\\"\\t"' || CASE WHEN c_nationkey % 3 = 1 THEN '' ELSE ', 246112005 |Severity| = #' || c_nationkey END
        || ', { 408729009 |Context| = ( ' || (id + 9) || ' ) }' END AS expression FROM c""")
def concept_expressions(spark, sf_dir):
    """An expression for each customer: two concepts, attributes with a text and a number, and a group with an expression in it."""
    c = table(spark, sf_dir, "customer").withColumn("concept", F.col("c_custkey") + 100000)
    focus = c.select(F.col("c_custkey").alias("id"), F.lit(1).alias("place"), expressions.concept_reference(F.col("concept"), F.col("c_name")).alias("concept"))
    focus = focus.union(c.select("c_custkey", F.lit(2), expressions.concept_reference(F.col("concept") + 7)))
    name = lambda number, term: expressions.concept_reference(F.lit(number), F.lit(term)).alias("name")
    own = lambda k, group, place, names, value: c.filter(F.col("c_nationkey") % 3 >= k).select(F.col("c_custkey").alias("id"), F.lit(group).cast("int").alias("group"), F.lit(place).alias("place"), names, value.alias("value"))
    texts = own(1, None, 1, name(363698007, "Finding site"), expressions.value_text(text=F.concat(F.lit('a "'), "c_name", F.lit('"\t'))))
    numbers = own(2, None, 2, name(246112005, "Severity"), expressions.value_text(number=F.col("c_nationkey")))
    nested = own(1, 1, 1, name(408729009, "Context"), expressions.value_text(expression=expressions.concept_reference(F.col("concept") + 9)))
    return expressions.expressions(focus, texts.union(numbers).union(nested))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || chr(10) || 'fixed' || chr(10) || 'z' ELSE 'a' || chr(10) || c_mktsegment || chr(10) || 'fixed' || chr(10) END AS text, true AS same FROM customer""")
def lines_added_and_compressed(spark, sf_dir):
    """A line added where it is absent; the texts are compressed and read again."""
    own = F.when(F.col("c_custkey") % 2 == 0, F.lit("a\nfixed\nz")).otherwise(F.concat(F.lit("a\n"), "c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", strings.line_added(own, "fixed").alias("text"))
    packed = rows.withColumn("packed", strings.gzipped()(F.col("text")))
    return packed.select("c_custkey", strings.gunzipped()(F.col("packed")).alias("text"), (F.hex(F.substring("packed", 1, 2)) == "1F8B").alias("same"))


@query("SELECT c_nationkey, string_agg(c_name || ';', '' ORDER BY c_custkey) AS text FROM customer GROUP BY 1")
def concatenated_texts(spark, sf_dir):
    return strings.concatenated(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", F.lit(";")).alias("text")), "c_nationkey", "c_custkey", "text")


@query("SELECT event_id, ts AS back, ts + INTERVAL 5 HOUR AS kept FROM events WHERE ts < TIMESTAMP '2024-03-01'")
def kept_times(spark, sf_dir):
    """Times of a zone, before its summer time, kept in UTC to the microsecond, and read again."""
    rows = table(spark, sf_dir, "events").filter("ts < TIMESTAMP_NTZ'2024-03-01'").select("event_id", dates.utc_micros(F.col("ts"), "America/New_York").alias("kept"))
    return rows.select("event_id", dates.from_utc_micros(F.col("kept"), "America/New_York").alias("back"), "kept")


@query()
def x86_hashes(spark, sf_dir):
    """128-bit hashes and random texts, which a test holds against a plain version."""
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", hashing.murmur128_x86()(F.col("c_name")).alias("hash"), strings.random_text(12, F.col("c_custkey"), seed=4).alias("drawn"))
