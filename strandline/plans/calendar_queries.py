"""Times as text and in zones, durations, calendar parts of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dates
from strandline.operators import intervals as I
from strandline.plans.registry import query, table

_SIGN = "CASE WHEN k % 7 = 0 THEN -1 ELSE 1 END"


@query(f"""WITH t AS (SELECT o_orderkey, o_orderkey AS k FROM orders) SELECT o_orderkey, CAST({_SIGN} * (12 * (k % 3) + k % 11) AS BIGINT) AS months, CAST({_SIGN} * (86400 * (k % 30) + 3600 * (k % 24) + 60 * (k % 59) + k % 60 + 0.5) AS DOUBLE) AS seconds,
    CASE WHEN k % 7 = 0 AND (12 * (k % 3) + k % 11) + 86400 * (k % 30) + 3600 * (k % 24) + 60 * (k % 59) + k % 60 > 0 THEN '-' ELSE '' END || 'P' || (12 * (k % 3) + k % 11) // 12 || 'Y' || (12 * (k % 3) + k % 11) % 12 || 'MT' || CAST(86400 * (k % 30) + 3600 * (k % 24) + 60 * (k % 59) + k % 60 AS VARCHAR) || 'S' AS text, true AS refused FROM t""")
def iso_durations(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.format_string("%sP%dY%dM%dDT%dH%dM%d.5S", F.when(k % 7 == 0, "-").otherwise(""), k % 3, k % 11, k % 30, k % 24, k % 59, k % 60)
    read = dates.duration_from_iso(text)
    whole = F.when(k % 7 == 0, F.ceil(read["seconds"])).otherwise(F.floor(read["seconds"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", read["months"].alias("months"), read["seconds"].alias("seconds"), dates.duration_to_iso(read["months"], whole).alias("text"), dates.duration_from_iso(F.concat(F.lit("x"), text)).isNull().alias("refused"))


@query("""SELECT event_id, ts + interval 5 hour AS utc, ts AS back, date_trunc('second', ts) - interval 2 hour AS from_offset, date_trunc('minute', ts) AS parsed, CAST(ts AS DATE) AS day, CAST(NULL AS TIMESTAMP) AS bad, date_trunc('second', ts) - interval 2 hour < TIMESTAMP '2024-01-10' AS early,
    strftime(ts, '%d/%m/%Y %H:%M') AS shown FROM events""")
def zones_and_parsing(spark, sf_dir):
    ts = F.col("ts")
    utc, offset = dates.to_utc(ts, "Etc/GMT+5"), dates.iso_to_utc(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    plain = F.date_format(ts, "dd/MM/yyyy HH:mm")
    return table(spark, sf_dir, "events").select(
        "event_id", utc.alias("utc"), dates.from_utc(utc, "Etc/GMT+5").alias("back"), offset.alias("from_offset"), dates.parse_datetime(plain, "dd/MM/yyyy HH:mm").cast("timestamp_ntz").alias("parsed"), dates.parse_date(F.date_format(ts, "yyyy-MM-dd")).alias("day"),
        dates.parse_datetime(F.lit("never"), "dd/MM/yyyy").cast("timestamp_ntz").alias("bad"), (offset < F.lit("2024-01-10").cast("timestamp_ntz")).alias("early"), plain.alias("shown"),
    )


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey * 37) % 10000 - 3000 AS m FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' ELSE CASE WHEN m < 0 THEN '-' ELSE '' END || abs(m) // 60 || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') END AS length FROM t""")
def hours_and_minutes(spark, sf_dir):
    start = F.lit("2024-01-05 10:00").cast("timestamp_ntz")
    end = F.when(F.col("o_orderkey") % 10 != 0, start + F.make_dt_interval(mins=((F.col("o_orderkey") * 37) % 10000 - 3000).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.hours_minutes(start, end).alias("length"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CAST(d AS TIMESTAMP) AS day_start, CAST(d + 1 AS TIMESTAMP) AS day_end, CAST(d + 3 AS TIMESTAMP) AS span_end, true AS none, CAST(d AS TIMESTAMP) + interval 7 hour AS light_start, CAST(d AS TIMESTAMP) + interval 19 hour AS light_end,
    isodow(d) = 6 AS saturday, isodow(d) = 7 AS sunday, CASE isodow(d) WHEN 6 THEN d WHEN 7 THEN d - 1 END AS weekend, strftime(d, '%Y-%m-%d') AS shown FROM d""")
def days_of_the_week(spark, sf_dir):
    d = F.to_date("o_orderdate")
    whole, light = I.whole_day(d), I.day_time(d)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", whole["start"].alias("day_start"), whole["end"].alias("day_end"), I.day_span(d, F.date_add(d, 2))["end"].alias("span_end"), (I.day_span(d, d).isNull() & I.day_span(d, F.date_sub(d, 1)).isNull()).alias("none"), light["start"].alias("light_start"), light["end"].alias("light_end"),
        I.is_saturday(d).alias("saturday"), I.is_sunday(d).alias("sunday"), I.saturday_of_weekend(d).alias("weekend"), F.date_format(d, "yyyy-MM-dd").alias("shown"),
    )


@query("""WITH e AS (SELECT event_id, ts AS s, ts + interval 6 hour AS e, CAST(CAST(ts AS DATE) AS TIMESTAMP) + interval 12 hour AS noon FROM events)
    SELECT event_id, s AS first, e AS last, s + interval 3 hour AS moved, s <= noon AND noon <= e AS holds_noon, least(s, noon) AS hull_start, greatest(e, noon + interval 1 hour) AS hull_end, CASE WHEN s <= noon + interval 1 hour AND e >= noon THEN least(e, noon + interval 1 hour) END AS common_end,
    CAST(CASE WHEN s < noon AND noon < e THEN 2 ELSE 1 END AS INTEGER) AS pieces, CASE WHEN s < noon AND noon < e THEN noon ELSE e END AS first_piece_end, CAST(6 AS DOUBLE) AS hours, CAST(0.25 AS DOUBLE) AS days FROM e""")
def interval_shapes(spark, sf_dir):
    s, e = F.col("start"), F.col("end")
    noon = F.to_date("ts").cast("timestamp_ntz") + F.expr("interval 12 hours")
    df = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("interval 6 hours")).alias("start"), F.col("ts").alias("end"), noon.alias("noon"))
    df = I.ordered(df)
    late = F.col("noon") + F.expr("interval 1 hour")
    hull, common, pieces = I.hull(s, e, F.col("noon"), late), I.intersection(s, e, F.col("noon"), late), I.cut(s, e, F.array("noon"))
    moved = I.shifted(df, F.expr("interval 3 hours")).select("event_id", F.col("start").alias("moved"))
    return df.join(moved, "event_id").select(
        "event_id", s.alias("first"), e.alias("last"), "moved", I.contains(s, e, F.col("noon")).alias("holds_noon"), hull["start"].alias("hull_start"), hull["end"].alias("hull_end"), common["end"].alias("common_end"), F.size(pieces).alias("pieces"), F.get(pieces, F.lit(0))["end"].alias("first_piece_end"),
        I.in_units(I.seconds("start", "end"), "h").alias("hours"), I.in_units(I.seconds("start", "end"), "d").alias("days"),
    )
