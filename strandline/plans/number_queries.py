"""Probabilities, logarithms, draws and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import dsp, hashing, probability, rounding
from strandline.plans.registry import query, table

_P = "(0.01 + 0.98 * CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000)"


@query(f"""SELECT event_id, round(p / (1 - p), 8) AS odds, round(p, 9) AS from_odds, round(ln(p / (1 - p)), 8) AS log_odds, round(p, 9) AS from_log_odds, round(ln(p), 8) AS log_p, round(p, 9) AS from_log_p, round(-ln(CAST(event_id % 9 + 2 AS DOUBLE) - 1), 9) AS one_in_n,
    round(0.3 * p / 0.5, 9) AS posterior, round(ln(CAST(0.3 AS DOUBLE)) + ln(p) - ln(CAST(0.5 AS DOUBLE)), 8) AS log_posterior, round(3 * p / (1 - p), 7) AS posterior_odds, round(ln(p) - ln(1 - p), 8) AS log_ratio, round(p * 2, 8) AS logistic_back FROM (SELECT event_id, {_P} AS p FROM events)""")
def probability_forms(spark, sf_dir):
    p, r = (F.lit(0.01) + F.lit(0.98) * ((F.col("event_id") * 7919) % 1000).cast("double") / 1000), rounding.round_scaled
    odds, log_odds = probability.odds_from_probability(p), probability.log_odds_from_probability(p)
    return table(spark, sf_dir, "events").select(
        "event_id", r(odds, 8).alias("odds"), r(probability.probability_from_odds(odds), 9).alias("from_odds"), r(log_odds, 8).alias("log_odds"), r(probability.probability_from_log_odds(log_odds), 9).alias("from_log_odds"),
        r(probability.log_probability_from_log_odds(log_odds), 8).alias("log_p"), r(probability.probability_from_log(probability.ln(p)), 9).alias("from_log_p"), r(probability.log_odds_from_1_in_n((F.col("event_id") % 9 + 2).cast("double")), 9).alias("one_in_n"),
        r(probability.bayes_posterior(p, F.lit(0.3), F.lit(0.5)), 9).alias("posterior"), r(probability.log_bayes_posterior(probability.ln(p), F.ln(F.lit(0.3)), F.ln(F.lit(0.5))), 8).alias("log_posterior"), r(probability.posterior_odds(odds, F.lit(3)), 7).alias("posterior_odds"),
        r(probability.log_likelihood_ratio(p, 1 - p), 8).alias("log_ratio"), r(probability.inv_logistic(probability.logistic(p * 2, 1.5, 0.5), 1.5, 0.5), 8).alias("logistic_back"),
    )


@query("""SELECT o_orderkey, round(ln(o_totalprice), 9) AS ln, round(log10(o_totalprice), 9) AS log10, CASE WHEN o_orderkey % 2 = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ln_of_bit, CAST((n + 1) * n / 2.0 AS DOUBLE) AS summed, CASE k WHEN 0 THEN 1 WHEN 1 THEN n ELSE n * (n - 1) END AS permutations,
    round(CAST(printf('%.2e', o_totalprice) AS DOUBLE), 6) AS rounded FROM (SELECT *, o_orderkey % 50 + 2 AS n, o_orderkey % 3 AS k FROM orders)""")
def logarithms_and_counts(spark, sf_dir):
    price, n, k = F.col("o_totalprice"), F.col("o_orderkey") % 50 + 2, F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rounding.round_scaled(probability.ln(price), 9).alias("ln"), rounding.round_scaled(probability.log10(price), 9).alias("log10"), probability.ln((F.col("o_orderkey") % 2 != 0).cast("double")).alias("ln_of_bit"),
        probability.sum_of_range(F.lit(1), n).cast("double").alias("summed"), probability.n_permutations(n, k).alias("permutations"), rounding.round_scaled(rounding.round_sf(price, 3), 6).alias("rounded"),
    )


@query("SELECT user_id, 1 AS picked, true AS likely FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def weighted_draws(spark, sf_dir):
    """One of four choices for each user: each has just one, and none that has no chance."""
    users = table(spark, sf_dir, "events").filter("user_id is not null").select("user_id").distinct()
    choices = users.select("user_id", F.posexplode(F.array(*map(F.lit, (0.0, 0.3, 0.7, 0.0)))).alias("choice", "p"))
    drawn = probability.pick(choices, ["user_id"], ["choice"], "p", seed=3)
    return drawn.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("picked"), F.bool_and(F.col("p") > 0).alias("likely"))


@query("SELECT true AS near")
def fair_coins(spark, sf_dir):
    """Whether heads come up about as often as they should; draws can be repeated."""
    heads = F.avg(probability.coin(F.lit(0.3), F.col("l_orderkey"), F.col("l_linenumber"), seed=1).cast("int"))
    return table(spark, sf_dir, "lineitem").agg((F.abs(heads - 0.3) < 2 / F.sqrt(F.count(F.lit(1)))).alias("near"))


def _convolved(taps):
    return "SELECT event_id, round(" + " + ".join(f"CAST({c!r} AS DOUBLE) * coalesce(lag(value, {k}) OVER w, 0)" for k, c in enumerate(taps)) + ", 6) AS filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


_HIGH, _BAND = dsp.highpass(9, 0.2, 1.0), dsp.bandpass(11, 0.1, 0.3, 1.0)


def _filtered(spark, sf_dir, taps):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return dsp.filtered(events, ["user_id"], ["ts", "event_id"], "value", taps).select("event_id", rounding.round_scaled(F.col("filtered"), 6).alias("filtered"))


@query(_convolved(_HIGH))
def fir_highpass(spark, sf_dir):
    return _filtered(spark, sf_dir, _HIGH)


@query(_convolved(_BAND))
def fir_bandpass(spark, sf_dir):
    return _filtered(spark, sf_dir, _BAND)


_AHEAD, _BACK = dsp.notch(0.1, 1.0, 5.0)
_NUM = lambda x: f"CAST({x!r} AS DOUBLE)"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id % 10 = 3),
    y AS (SELECT event_id, user_id, k, value AS x1, CAST(0 AS DOUBLE) AS x2, {_NUM(_AHEAD[0])} * value AS y1, CAST(0 AS DOUBLE) AS y2 FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.user_id, e.k, e.value, y.x1, {_NUM(_AHEAD[0])} * e.value + {_NUM(_AHEAD[1])} * y.x1 + {_NUM(_AHEAD[2])} * y.x2 - {_NUM(_BACK[1])} * y.y1 - {_NUM(_BACK[2])} * y.y2, y.y1 FROM y JOIN e ON e.user_id = y.user_id AND e.k = y.k + 1)
    SELECT user_id, count(*) AS n, round(sum(y1), 4) AS total, round(max(abs(y1)), 5) AS largest FROM y GROUP BY user_id""".replace(" WHERE user_id % 10 = 3", " WHERE user_id IS NOT NULL"))
def notch_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", "user_id", "ts", "value")
    out = dsp.recursive_filtered(events, ["user_id"], ["ts", "event_id"], "value", _AHEAD, _BACK)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), rounding.round_scaled(F.sum("filtered"), 4).alias("total"), rounding.round_scaled(F.max(F.abs("filtered")), 5).alias("largest"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 256 >= 128 THEN c_custkey % 256 - 256 ELSE c_custkey % 256 END AS INTEGER) AS signed, CAST(c_custkey % 256 AS INTEGER) AS unsigned, md5(c_name) AS digest FROM customer")
def signed_numbers(spark, sf_dir):
    signed = hashing.to_signed(F.col("c_custkey") % 256, 8)
    return table(spark, sf_dir, "customer").select("c_custkey", signed.cast("int").alias("signed"), hashing.to_unsigned(signed, 8).cast("int").alias("unsigned"), hashing.file_digest(F.col("c_name").cast("binary")).alias("digest"))
