"""Probabilities, odds and their logarithms; logistic curves; softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.sqlops import running_sum

_LOW = float("-inf")


def ln(x: Column) -> Column:
    """Natural logarithm; of zero minus infinity, of a negative number an error."""
    return F.when(x < 0, F.raise_error("logarithm of a negative number").cast("double")).when(x == 0, F.lit(_LOW)).otherwise(F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x < 0, F.raise_error("logarithm of a negative number").cast("double")).when(x == 0, F.lit(_LOW)).otherwise(F.log10(x))


def safe_logit(p: Column) -> Column:
    """Null outside [0, 1], infinite at its ends."""
    return F.when((p < 0) | (p > 1), F.lit(None).cast("double")).when(p == 0, F.lit(_LOW)).when(p == 1, F.lit(float("inf"))).otherwise(F.ln(p / (1 - p)))


def odds_from_probability(p: Column) -> Column:
    return p / (1 - p)


def probability_from_odds(odds: Column) -> Column:
    return F.when(odds == float("inf"), F.lit(1.0)).otherwise(odds / (1 + odds))


def log_odds_from_probability(p: Column) -> Column:
    return F.when(p == 1, F.lit(float("inf"))).otherwise(ln(p / F.when(p == 1, F.lit(1.0)).otherwise(1 - p)))


def probability_from_log_odds(x: Column) -> Column:
    return probability_from_odds(F.exp(x))


def log_probability_from_log_odds(x: Column) -> Column:
    return ln(probability_from_log_odds(x))


def log_odds_from_1_in_n(n: Column) -> Column:
    return -ln(n - 1)


def bayes_posterior(prior: Column, likelihood: Column, marginal: Column) -> Column:
    return likelihood * prior / marginal


def log_bayes_posterior(log_prior: Column, log_likelihood: Column, log_marginal: Column) -> Column:
    return log_likelihood + log_prior - log_marginal


def posterior_odds(prior_odds: Column, likelihood_ratio: Column) -> Column:
    return likelihood_ratio * prior_odds


def log_likelihood_ratio(p_given_h: Column, p_given_not_h: Column) -> Column:
    return ln(p_given_h) - ln(p_given_not_h)


def log_odds_update(log_prior_odds: Column, seen: Column, p_given_h: Column, p_given_not_h: Column) -> Column:
    """Log odds of h after data that were seen or not."""
    yes, no = log_likelihood_ratio(p_given_h, p_given_not_h), log_likelihood_ratio(1 - p_given_h, 1 - p_given_not_h)
    return log_prior_odds + F.when(seen, yes).otherwise(no)


def running_log_odds(df: DataFrame, keys: Sequence[str], order: Sequence, seen: Column, p_given_h: float, p_given_not_h: float, prior: float = 0.0) -> DataFrame:
    """Log odds after each row of a key, in order: updates are a running sum. Without keys the sum runs over all rows, by ranges."""
    step = log_odds_update(F.lit(0.0), seen, F.lit(p_given_h), F.lit(p_given_not_h))
    if not keys:
        return running_sum(df, order, step, "_sum").withColumn("log_odds", F.lit(prior) + F.col("_sum")).drop("_sum")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("log_odds", F.lit(prior) + F.sum(step).over(w))


def logistic(x: Column, k: float, theta: float) -> Column:
    return 1 / (1 + F.exp(-F.lit(k) * (x - theta)))


def inv_logistic(y: Column, k: float, theta: float) -> Column:
    return F.ln(1 / y - 1) / -F.lit(k) + theta


def softmax(df: DataFrame, keys: Sequence[str], value: str, b: float = 1.0) -> DataFrame:
    """exp(b x) over its sum within each key, steadied by the key's mean; one-hot at the largest where that overflows.

    Keys' sums are aggregates that rows are joined to, so a key may have any number of rows.
    """
    own = lambda t: t.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    means = own(df.groupBy(*keys).agg(F.avg(value).alias("_a"), F.max(value).alias("_m"), F.count(F.lit(1)).alias("_n")))
    out = df.join(means, same).withColumn("_e", F.exp(F.lit(b) * F.col(value) - F.col("_a"))).drop(*[f"_{k}" for k in keys], "_a")
    out = out.join(own(out.groupBy(*keys).agg(F.sum("_e").alias("_s"))), same).drop(*[f"_{k}" for k in keys])
    share = F.when(F.col("_s") == float("inf"), (F.col(value) == F.col("_m")).cast("double")).when(F.col("_s") == 0, 1 / F.col("_n")).otherwise(F.col("_e") / F.col("_s"))
    return out.withColumn("softmax", share).drop("_e", "_s", "_m", "_n")


def pick(df: DataFrame, keys: Sequence[str], order: Sequence, probability: str, seed: int = 0) -> DataFrame:
    """One row of each key, drawn with the given probabilities; the draw is a hash of the key and seed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    met = df.withColumn("_upto", F.sum(probability).over(w)).filter(F.col("_upto") > draw)
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_upto"))).filter("_r = 1").drop("_upto", "_r")


def probability_from_log(log_p: Column) -> Column:
    return F.exp(log_p)


def coin(p: Column, *key: Column, seed: int = 0) -> Column:
    """True with the given probability: a draw that is a hash of key and seed, so that it can be repeated."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) < p


def sum_of_range(a: Column, b: Column) -> Column:
    """Sum of the integers from a to b."""
    return (b - a + 1) * (a + b) / 2


def n_permutations(n: Column, k: Column) -> Column:
    return F.aggregate(F.when(k > 0, F.sequence(n - k + 1, n)).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda x, y: x * y)
