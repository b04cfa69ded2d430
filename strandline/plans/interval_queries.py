"""Interval, timeline and episode queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strandline.operators import intervals as I
from strandline.operators.episodes import two_drug_episodes
from strandline.operators.timeline import cumulative_time as _cumulative_time
from strandline.plans.registry import query, table

SIX_HOURS = "interval 6 hours"

_IV = "iv AS (SELECT user_id, ts AS s, ts + interval '6' hour AS e, event_type FROM events)"
_ISLANDS = f"""{_IV},
    mk AS (SELECT user_id, s, e, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM iv),
    il AS (SELECT user_id, s, e, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM mk),
    m AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM il GROUP BY user_id, k)"""
_GAPS = f"{_ISLANDS}, g AS (SELECT * FROM (SELECT user_id, e AS g0, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS g1 FROM m) WHERE g1 IS NOT NULL)"
_SEC = "date_diff('microsecond', {a}, {b}) // 1000000"
_DAYS = "d AS (SELECT user_id, s, e, CAST(unnest(generate_series(CAST(s AS DATE), CAST(e AS DATE), interval 1 day)) AS DATE) AS day FROM iv)"


def _spans(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr(SIX_HOURS)).alias("end"), *columns)


def _merged(spark, sf_dir):
    return I.coalesce(_spans(spark, sf_dir), ["user_id"])


@query(f"WITH {_ISLANDS} SELECT user_id, s AS start, e AS \"end\", n FROM m")
def interval_coalesce(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"WITH {_GAPS} SELECT user_id, g0 AS start, g1 AS \"end\" FROM g")
def interval_gaps(spark, sf_dir):
    return I.gaps(_merged(spark, sf_dir), ["user_id"])


@query(f"WITH {_ISLANDS} SELECT user_id, min(s) AS start, max(e) AS \"end\", CAST(sum({_SEC.format(a='s', b='e')}) AS BIGINT) AS total_seconds FROM m GROUP BY user_id")
def interval_extent_total(spark, sf_dir):
    return I.extent(_merged(spark, sf_dir), ["user_id"])


@query(f"""WITH {_ISLANDS}, r AS (SELECT user_id, s, {_SEC.format(a='s', b='e')} AS d FROM m),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, s) AS l, row_number() OVER (PARTITION BY user_id ORDER BY d, s) AS k FROM r)
    SELECT user_id, max(d) AS longest_seconds, max(CASE WHEN l = 1 THEN s END) AS longest_start, min(d) AS shortest_seconds, max(CASE WHEN k = 1 THEN s END) AS shortest_start FROM q GROUP BY user_id""")
def interval_longest_shortest(spark, sf_dir):
    return I.longest_and_shortest(_merged(spark, sf_dir), ["user_id"])


@query(f"""WITH {_IV}, p AS (SELECT user_id, ts AS s, ts + interval '6' hour AS e, CASE WHEN value > 50 THEN 1 WHEN value <= 50 THEN 2 END AS k FROM events)
    SELECT a.user_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM p a JOIN p b ON a.user_id = b.user_id AND a.k = 1 AND b.k = 2 AND a.s <= b.e AND a.e >= b.s""")
def interval_overlap_pairs(spark, sf_dir):
    spans = _spans(spark, sf_dir, "value")
    return I.pair_overlaps(spans.filter("value > 50"), spans.filter("value <= 50"), ["user_id"])


@query(f"""WITH {_IV}, x AS (SELECT user_id, s > lag(e) OVER (PARTITION BY user_id ORDER BY s, e) AS apart FROM iv)
    SELECT user_id, coalesce(bool_or(NOT apart), false) AS any_overlap FROM x GROUP BY user_id""")
def interval_any_overlap(spark, sf_dir):
    return I.any_overlap(_spans(spark, sf_dir), ["user_id"], touching=True)


_LOW, _HIGH = "2024-01-08 00:00:00", "2024-01-15 00:00:00"


def _subset(flexibility, test):
    low, high = f"TIMESTAMP '{_LOW}'", f"TIMESTAMP '{_HIGH}'"

    def f(spark, sf_dir):
        ends = [F.lit(datetime.fromisoformat(x)).cast("timestamp_ntz") for x in (_LOW, _HIGH)]
        return I.subset(_merged(spark, sf_dir), *ends, flexibility=flexibility)

    f.__name__ = f"interval_subset_flex{flexibility}"
    query(f"WITH {_ISLANDS} SELECT user_id, s AS start, e AS \"end\", n FROM m WHERE {test.format(low=low, high=high)}")(f)


for _flexibility, _test in enumerate(("s > {low} AND e < {high}", "s < {high} AND e > {low}", "s <= {high} AND e >= {low}")):
    _subset(_flexibility, _test)

_PART = "greatest(s, CAST(day AS TIMESTAMP)) AS p0, least(e, CAST(day AS TIMESTAMP) + interval 1 day) AS p1"
_IN = f"greatest({_SEC.format(a='greatest(p0, CAST(day AS TIMESTAMP) + interval 7 hour)', b='least(p1, CAST(day AS TIMESTAMP) + interval 19 hour)')}, 0)"
_ALL = _SEC.format(a="p0", b="p1")


@query(f"""WITH {_IV}, {_DAYS}, p AS (SELECT user_id, day, {_PART} FROM d)
    SELECT user_id, CAST(sum({_IN}) AS BIGINT) AS day_seconds, CAST(sum({_ALL} - {_IN}) AS BIGINT) AS night_seconds FROM p GROUP BY user_id""")
def interval_day_night(spark, sf_dir):
    return I.day_night(_spans(spark, sf_dir), ["user_id"])


_HOLIDAYS = ["2024-01-01", "2024-03-29", "2024-04-01"]


@query(f"""WITH {_IV}, {_DAYS}, p AS (SELECT user_id, day, {_PART} FROM d)
    SELECT user_id, CAST(sum(CASE WHEN isodow(day) < 6 AND CAST(day AS VARCHAR) NOT IN ({', '.join(repr(x) for x in _HOLIDAYS)}) THEN {_ALL} - {_IN} ELSE {_ALL} END) AS BIGINT) AS outside_seconds FROM p GROUP BY user_id""")
def interval_outside_hours(spark, sf_dir):
    holidays = spark.createDataFrame([(x,) for x in _HOLIDAYS], "day string").select(F.to_date("day").alias("day"))
    return I.outside_hours(_spans(spark, sf_dir), ["user_id"], holidays)


@query(f"""WITH {_IV}, {_DAYS}, u AS (SELECT DISTINCT user_id FROM iv), w AS (SELECT user_id, count(DISTINCT CASE WHEN isodow(day) = 7 THEN day - 1 ELSE day END) AS n FROM d WHERE isodow(day) >= 6 GROUP BY user_id)
    SELECT user_id, coalesce(n, 0) AS n_weekends FROM u LEFT JOIN w USING (user_id)""")
def interval_weekends(spark, sf_dir):
    return I.weekends(_spans(spark, sf_dir), ["user_id"])


@query(f"""WITH {_IV}, {_DAYS}, u AS (SELECT DISTINCT user_id, day FROM d), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS k FROM u),
    c AS (SELECT user_id, count(*) AS n_days, min(day) AS first_day FROM r GROUP BY user_id, k)
    SELECT user_id, n_days, first_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_days DESC, first_day) AS z FROM c) WHERE z = 1""")
def consecutive_days(spark, sf_dir):
    return I.consecutive_days(_spans(spark, sf_dir), ["user_id"])


@query(f"""WITH {_GAPS}, x AS (SELECT user_id, CAST(min(s) AS DATE) AS f, CAST(max(e) AS DATE) AS l, count(*) AS n FROM m GROUP BY user_id),
    k AS (SELECT user_id, unnest(CASE WHEN date_diff('day', f, l) + 1 <= 14 THEN [0] ELSE range(0, date_diff('day', f, l) + 1 - 14) END) AS k, f, l FROM x WHERE n > 1),
    b AS (SELECT user_id, k, CAST(f + CAST(k AS INTEGER) AS TIMESTAMP) AS lo, CAST((CASE WHEN date_diff('day', f, l) + 1 <= 14 THEN l ELSE f + CAST(k AS INTEGER) + 14 END) + 1 AS TIMESTAMP) AS hi FROM k),
    q AS (SELECT user_id, k, {_SEC.format(a='g0', b='g1')} AS d, row_number() OVER (PARTITION BY user_id, k ORDER BY date_diff('microsecond', g0, g1) DESC) AS z FROM b JOIN g USING (user_id) WHERE g0 <= hi AND g1 >= lo),
    o AS (SELECT b.user_id, b.k, coalesce(bool_or(z = 1 AND d >= 172800), false) AND coalesce(bool_or(z = 2 AND d >= 86400), false) AS good FROM b LEFT JOIN q ON q.user_id = b.user_id AND q.k = b.k GROUP BY 1, 2)
    SELECT x.user_id, coalesce(bool_and(good), false) AS sufficient FROM x LEFT JOIN o USING (user_id) GROUP BY x.user_id""")
def sufficient_gaps(spark, sf_dir):
    return I.sufficient_gaps(_merged(spark, sf_dir), ["user_id"], 14, [86400, 172800])


@query(f"WITH {_GAPS}, r AS (SELECT user_id, g0, g1, {_SEC.format(a='g0', b='g1')} AS d, row_number() OVER (PARTITION BY user_id ORDER BY {_SEC.format(a='g0', b='g1')}, g0) AS k FROM g) SELECT user_id, g0 AS start, g1 AS \"end\", d AS seconds FROM r WHERE k = 1")
def interval_shortest_gap(spark, sf_dir):
    return I.shortest_gap(_merged(spark, sf_dir), ["user_id"])


@query(f"WITH {_GAPS} SELECT user_id, g0 AS start, g1 AS \"end\" FROM g WHERE g0 < TIMESTAMP '{_HIGH}' AND g1 > TIMESTAMP '{_LOW}'")
def interval_gap_subset(spark, sf_dir):
    low, high = (F.lit(datetime.fromisoformat(x)).cast("timestamp_ntz") for x in (_LOW, _HIGH))
    return I.gap_subset(_merged(spark, sf_dir), ["user_id"], low, high, flexibility=1)


@query(f"""WITH h AS (SELECT user_id, date_trunc('day', ts) AS s, date_trunc('day', ts) + (1 + event_id % 3) * interval 1 day AS e FROM events)
    SELECT user_id, TIMESTAMP '{_LOW}' AS start, min(e) AS "end", 'starting' AS which FROM h WHERE s = TIMESTAMP '{_LOW}' GROUP BY user_id UNION ALL SELECT user_id, min(s), TIMESTAMP '{_HIGH}', 'ending' FROM h WHERE e = TIMESTAMP '{_HIGH}' GROUP BY user_id""")
def interval_first_at(spark, sf_dir):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    spans = table(spark, sf_dir, "events").select("user_id", day.alias("start"), (day + F.make_dt_interval((1 + F.col("event_id") % 3).cast("int"))).alias("end"))
    low, high = (F.lit(datetime.fromisoformat(x)).cast("timestamp_ntz") for x in (_LOW, _HIGH))
    return I.first_starting(spans, ["user_id"], low).withColumn("which", F.lit("starting")).unionByName(I.first_ending(spans, ["user_id"], high).withColumn("which", F.lit("ending")))


@query(f"""WITH {_IV}, x AS (SELECT user_id, s >= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM iv)
    SELECT user_id, coalesce(bool_or(NOT apart), false) AS any_overlap FROM x GROUP BY user_id""")
def interval_any_true_overlap(spark, sf_dir):
    return I.any_overlap(_spans(spark, sf_dir), ["user_id"])


_AT = ["2024-01-05 00:00:00", "2024-01-12 00:00:00", "2024-01-20 12:00:00", "2023-12-20 00:00:00"]
_START = "2024-01-01 00:00:00"


@query(f"""WITH {_ISLANDS}, q AS (SELECT DISTINCT user_id, TIMESTAMP '{_START}' AS start, CAST(unnest([{', '.join(repr(x) for x in _AT)}]) AS TIMESTAMP) AS w FROM events),
    t AS (SELECT q.user_id, q.start, q.w, min(s) AS f, CAST(sum(CASE WHEN s < w THEN {_SEC.format(a='s', b='least(e, w)')} ELSE 0 END) AS BIGINT) AS du FROM q LEFT JOIN m USING (user_id) GROUP BY 1, 2, 3),
    o AS (SELECT user_id, start, w, CASE WHEN w <= start THEN 0 WHEN f IS NULL OR w <= f THEN {_SEC.format(a='start', b='w')} ELSE greatest({_SEC.format(a='start', b='f')}, 0) END AS b,
        CASE WHEN w <= start OR f IS NULL OR w <= f THEN 0 ELSE du END AS d, CASE WHEN w <= start OR f IS NULL OR w <= f THEN 0 ELSE {_SEC.format(a='f', b='w')} - du END AS a FROM t)
    SELECT user_id, start, w AS "when", b AS before_seconds, d AS during_seconds, a AS after_seconds, b // 86400 AS before_days, d // 86400 AS during_days, a // 86400 AS after_days FROM o""")
def cumulative_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    at = F.explode(F.array(*[F.lit(x).cast("timestamp_ntz") for x in _AT]))
    asked = events.select("user_id").distinct().select("user_id", F.lit(_START).cast("timestamp_ntz").alias("start"), at.alias("when"))
    return _cumulative_time(events, asked, "user_id", "ts", F.expr(SIX_HOURS))


@query("""WITH tp AS (SELECT o_custkey AS p, o_orderpriority AS drug, CAST(o_orderdate AS DATE) AS dt, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderpriority) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    t AS (SELECT * FROM tp WHERE n >= 4),
    a AS (SELECT x.p, x.drug, x.dt, x.rn, min(y.dt) AS dt2 FROM t x JOIN t y ON x.p = y.p AND x.drug = y.drug AND y.dt >= x.dt + 27 GROUP BY 1, 2, 3, 4),
    b AS (SELECT a.p, a.drug, a.dt, a.dt2, a.rn, count(*) AS na FROM a JOIN t o ON o.p = a.p AND o.drug <> a.drug AND o.dt <= a.dt WHERE a.rn >= 1 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2),
    c AS (SELECT b.p, a.drug AS da, a.dt AS a1, a.dt2 AS a2, a.rn AS ra, b.drug AS db, b.dt AS b1, b.dt2 AS b2, b.rn AS rb FROM b JOIN a ON a.p = b.p AND a.rn <= b.na - 2 AND a.dt + 27 <= b.dt
          WHERE NOT EXISTS (SELECT 1 FROM t z WHERE z.p = b.p AND z.drug = b.drug AND z.dt >= a.dt AND z.dt < a.dt2)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY rb, ra) AS k FROM c)
    SELECT p AS patient_id, da AS drug_a_name, a1 AS drug_a_first, a2 AS drug_a_second, db AS drug_b_name, b1 AS drug_b_first, b2 AS drug_b_second, b1 + 56 AS expect_response_to_b_by, b1 + 235 AS end_of_symptom_period FROM r WHERE k = 1""")
def two_episode_switch(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return two_drug_episodes(orders, "o_custkey", "o_orderpriority", "day")
