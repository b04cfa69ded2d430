"""Queries over joins by order: many ranges, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import lookup
from strandline.operators.ordered import as_of
from strandline.plans.registry import query, table


@query("""WITH r AS (SELECT o_orderkey AS ordinal, o_totalprice AS low, o_totalprice + 20 AS high, o_orderpriority AS label FROM orders),
    m AS (SELECT l_extendedprice, min(ordinal) AS ordinal FROM (SELECT DISTINCT l_extendedprice FROM lineitem) JOIN r ON l_extendedprice >= low AND l_extendedprice < high GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, label FROM lineitem l LEFT JOIN m USING (l_extendedprice) LEFT JOIN r USING (ordinal)""")
def range_lookup_many(spark, sf_dir):
    """A range for each order: overlapping ones by the thousand, of which the first by key counts."""
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("low"), (F.col("o_totalprice") + 20).alias("high"), F.col("o_orderpriority").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lookup.range_lookup(lines, "l_extendedprice", ranges).drop("l_extendedprice")


_OWN = "SELECT user_id, ts, max(event_id) AS met_id FROM events WHERE event_type = '{}' AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL"


@query(f"""SELECT event_id, CASE WHEN p.ts >= e.ts - INTERVAL 2 DAY THEN met_id END AS purchase FROM events e ASOF LEFT JOIN ({_OWN.format("purchase")}) p ON e.user_id = p.user_id AND e.ts > p.ts""")
def asof_last_purchase(spark, sf_dir):
    """For each event the user's last purchase before it, within two days."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    met = as_of(events.select("event_id", "user_id", "ts"), bought, "ts", "ts", ["user_id"], within=F.expr("INTERVAL 2 DAYS"), exact=False)
    return met.select("event_id", F.col("met.event_id").alias("purchase"))


@query(f"""WITH p AS ({_OWN.format("error")}), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
    b AS (SELECT event_id, e.ts, p.ts AS b_ts, met_id AS b_id FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts),
    f AS (SELECT event_id, p.ts AS f_ts, met_id AS f_id FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts)
    SELECT event_id, CASE WHEN b_ts IS NULL OR f_ts - b.ts < b.ts - b_ts THEN f_id ELSE b_id END AS error, CASE WHEN b_ts IS NULL OR f_ts - b.ts < b.ts - b_ts THEN f_ts ELSE b_ts END AS error_ts FROM b JOIN f USING (event_id)""")
def asof_nearest_error(spark, sf_dir):
    """For each click the user's error nearest to it, before or after."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.filter("event_type = 'error'").select("user_id", "ts", "event_id")
    met = as_of(events.filter("event_type = 'click'"), errors, "ts", "ts", ["user_id"], "nearest")
    return met.select("event_id", F.col("met.event_id").alias("error"), F.col("met.ts").alias("error_ts"))
