"""Two-drug episodes: a course of drug A, then a course of drug B begun after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import as_of
from strandline.operators.storage import ended


def two_drug_episodes(mentions: DataFrame, patient: str, drug: str, date: str, course_days: int = 28, response_days: int = 56, symptom_days: int = 180, first_only: bool = True) -> DataFrame:
    """Each patient's first A-to-B episode (or one A for every B).

    Mentions are numbered by date, then drug; patients of fewer than four have none. B is any mention but the first with
    a later mention of the drug at least course_days - 1 days on. With n mentions of other drugs up to B's day, A is one
    of the first n - 1 mentions of all, with a later one of its drug as far on, begun at least that long before B, and
    with no mention of B's drug from A's first to before A's second. Lowest B, then lowest A wins.
    """
    span = course_days - 1
    days = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    rows = mentions.select(F.col(patient).alias("p"), F.col(drug).alias("drug"), F.col(date).cast("date").alias("date"), days.alias("d"))
    rows = rows.filter("p is not null and drug is not null and date is not null")
    everyone, own = Window.partitionBy("p"), Window.partitionBy("p", "drug")
    upto = lambda w: w.orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    ranked = rows.select(
        "*",
        (F.row_number().over(everyone.orderBy("date", "drug")) - 1).alias("rank"),
        F.count(F.lit(1)).over(everyone).alias("n"),
        F.min("d").over(own.orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, -span)).alias("second"),  # a frame that only grows
        (F.count(F.lit(1)).over(upto(everyone)) - F.count(F.lit(1)).over(upto(own))).alias("others"),
    ).filter("n >= 4")
    may_be_b = (F.col("rank") >= 1) & (F.col("others") >= 2) & F.col("second").isNotNull()
    ranked = ranked.withColumn("bs", F.collect_set(F.when(may_be_b, F.col("drug"))).over(everyone)).filter("second is not null")
    ranked = ended(ranked.select("p", "drug", "d", "rank", "others", "second", "bs"), "episodes")
    b = ranked.filter(may_be_b).select("p", F.col("drug").alias("b"), F.col("d").alias("b1"), F.col("second").alias("b2"), F.col("rank").alias("b_rank"), "others")
    # for each drug that may be B the first A without a mention of it: if that A is too late for a B, so are all later ones
    beside = ranked.select("p", F.col("drug").alias("a"), F.col("d").alias("a1"), F.col("second").alias("a2"), F.col("rank").alias("a_rank"), F.explode("bs").alias("b")).filter("a <> b")
    seen = rows.select("p", F.col("drug").alias("b"), "d")
    beside = as_of(beside, seen, "a1", "d", ["p", "b"], "forward", cut=False).filter("met is null or met.d >= a2")
    earliest = beside.groupBy("p", "b").agg(F.min(F.struct("a_rank", "a", "a1", "a2")).alias("first")).select("p", "b", "first.*")
    clear = b.join(earliest, ["p", "b"]).filter((F.col("a_rank") <= F.col("others") - 2) & (F.col("a1") + span <= F.col("b1")))
    one = ["p"] if first_only else ["p", "b_rank"]
    first = clear.groupBy(*one).agg(F.min(F.struct("b_rank", "a_rank", "a", "a1", "a2", "b", "b1", "b2")).alias("m")).select("p", "m.*")
    when = lambda c: F.date_from_unix_date(F.col(c) if isinstance(c, str) else c)
    return first.select(
        F.col("p").alias("patient_id"),
        F.col("a").alias("drug_a_name"),
        when("a1").alias("drug_a_first"),
        when("a2").alias("drug_a_second"),
        F.col("b").alias("drug_b_name"),
        when("b1").alias("drug_b_first"),
        when("b2").alias("drug_b_second"),
        when(F.col("b1") + response_days).alias("expect_response_to_b_by"),
        when(F.col("b1") + response_days + symptom_days - 1).alias("end_of_symptom_period"),
    )
