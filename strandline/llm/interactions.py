"""How filters that are applied one after another share what they remove.

Every text is reduced to a mask of the filters it fails; masks are counted by part. For a part with n_m texts of mask m, the
number removed is the multilinear polynomial f(x) = sum over m of n_m (1 - product over i in m of (1 - x_i)), a variable for
each filter. Its value at a corner (a set of filters at 1, the rest at 0) is what those filters remove together, so survivors
of every order and step come from corners. The Shapley value of filter i is the integral of df/dx_i along the diagonal, taken
term by term in exact fractions; k! times it is a whole number.

Counting takes the whole work: masks come from Spark's own functions, equal rows meet in sums before they are shuffled, and
what a part's polynomial is made of is one row a mask. A null text is empty, a null part the empty string; a document is counted
once for each of its rows, labelled if any of the labels' rows of its id says so. A null id is neither smaller nor larger than
any, so it makes no copy and is none. No documents, no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def failing(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of the words distinct), C (over 3 % capitals A-Z), D (odd signs)."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.char_length(text), F.translate(text, "#$%&*|", "") != text]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): ``docs`` has doc_id, text, part; filter i of ``FILTERS`` is bit i of the mask."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(failing(text))]
    mask = bits[0] + bits[1] + bits[2] + bits[3]
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("part", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), mask.alias("mask"))
    each = each.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # rows without an id have no label and are kept out of the join, where they would be one key
    told = each.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").select("doc_id", "part", "key", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    told = told.unionByName(each.filter("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    # of a text's rows alike in all but the id only those of the smallest id may be the first; a text has few such kinds
    kinds = told.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    )
    lowest = F.min("first.doc_id").over(Window.partitionBy("key"))
    passes = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    dealt = kinds.withColumn("lowest", lowest).withColumn("passes", passes).select("part", "good", "toxic", split.alias("of"))
    of = lambda told: F.sum(F.when(told, F.col("of.n")).otherwise(0))
    return dealt.groupBy("part", F.col("of.mask").alias("mask")).agg(F.sum("of.n").alias("n"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))


def polynomial(counts: Iterable[tuple[int, int]], k: int) -> list[int]:
    """Coefficients, by set of variables, of the number removed; ``counts`` are (mask, texts)."""
    counts = list(counts)
    out = [0] * (1 << k)
    for term in range(1, 1 << k):
        sign = 1 if term.bit_count() % 2 else -1
        out[term] = sign * sum(n for mask, n in counts if mask & term == term)
    return out


def corner(coefficients: list[int], filters: int) -> int:
    """The polynomial's value with the variables of ``filters`` at 1 and the others at 0."""
    return sum(c for term, c in enumerate(coefficients) if term & filters == term)


def shapley(coefficients: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the derivative by variable i where all variables are t: c t**(m-1) gives c / m."""
    return sum((Fraction(c, term.bit_count()) for term, c in enumerate(coefficients) if term >> i & 1), Fraction(0))


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The report of ``mask_counts``: for each part, order of the filters ``names`` (a letter each) and step, one row."""
    k = len(names)

    def report(group: pd.DataFrame) -> pd.DataFrame:
        removed, good, toxic = (polynomial(zip(group["mask"].tolist(), group[c].tolist()), k) for c in ("n", "good", "toxic"))
        total, every = int(group["n"].sum()), (1 << k) - 1
        values = [[corner(p, s) for s in range(1 << k)] for p in (removed, good, toxic)]
        shares = [int(factorial(k) * shapley(removed, i)) for i in range(k)]
        rows = []
        for order in permutations(range(k)):
            before = 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                here, good_here, toxic_here = (v[after] - v[before] for v in values)
                only = values[0][every] - values[0][every ^ 1 << i]
                rows.append((group["part"].iloc[0], "".join(names[j] for j in order), step, total - values[0][after], here, values[0][1 << i] - here, only, good_here, toxic_here, shares[i]))
                before = after
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    return counts.groupBy("part").applyInPandas(report, REPORT)
