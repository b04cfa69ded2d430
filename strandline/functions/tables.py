"""Table functions and functions for use in SQL.

    tables.register(spark)
    SELECT * FROM merged_intervals(TABLE(SELECT who, begins, ends FROM stays) PARTITION BY who ORDER BY begins)
    SELECT d.day, d.hours FROM stays, LATERAL interval_days(begins, ends) d

A function over a table sees one partition's rows in order and keeps one interval at a time, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, time, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


class MergedIntervals:
    """Rows (key, begins, ends, n) of a table (key, begins, ends) in order of begins, merged where they overlap or touch.

    Rows with a null end of either kind, or that end before they begin, are left out.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 3:
            raise ValueError("a table of three columns is needed: key, begins, ends")
        key, begins, ends = rows.dataType.fields
        return AnalyzeResult(StructType([StructField("key", key.dataType), StructField("begins", begins.dataType), StructField("ends", ends.dataType), StructField("n", LongType())]))

    def __init__(self):
        self.held = None

    def eval(self, row) -> Iterator[tuple]:
        key, begins, ends = row
        if begins is None or ends is None or ends < begins:
            return
        if self.held is not None and begins <= self.held[2]:
            _, first, last, n = self.held
            self.held = key, first, max(last, ends), n + 1
            return
        if self.held is not None:
            yield self.held
        self.held = key, begins, ends, 1

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self.held


class IntervalDays:
    """Rows (day, hours, weekday) of the days that an interval of two times touches; Monday is 1. An empty interval has none."""

    def eval(self, begins: datetime, ends: datetime) -> Iterator[tuple]:
        while begins is not None and ends is not None and begins < ends:
            midnight = datetime.combine(begins.date() + timedelta(days=1), time.min, begins.tzinfo)
            until = min(midnight, ends)
            yield begins.date(), (until - begins).total_seconds() / 3600, begins.isoweekday()
            begins = until


class CsvBlock:
    """Rows (line, place, name, value) of a block of comma-separated lines inside a text: from the line that is the header, whose
    fields are the names, to the next blank line. Quoted fields may hold commas and doubled quotes."""

    def eval(self, text: str, header: str) -> Iterator[tuple]:
        import csv

        names, inside = next(csv.reader([header])), False
        for number, line in enumerate((text or "").split("\n")):
            if not inside:
                inside = line.startswith(header)
                continue
            if not line.strip():
                return
            for place, (name, value) in enumerate(zip(names, next(csv.reader([line])))):
                yield number, place, name, value


_DAYS = StructType([StructField("day", DateType()), StructField("hours", DoubleType()), StructField("weekday", IntegerType())])
_BLOCK = StructType([StructField("line", IntegerType()), StructField("place", IntegerType()), StructField("name", StringType()), StructField("value", StringType())])

#: SQL functions: name, arguments, result.
SQL_FUNCTIONS = {
    "blank_to_null": ("x STRING", "STRING", "CASE WHEN trim(x) = '' THEN NULL ELSE x END"),
    "first_of_month": ("d DATE", "DATE", "trunc(d, 'MM')"),
    "age_at": ("born DATE, at DATE", "INT", "CAST(floor(months_between(at, born) / 12) AS INT)"),
    "overlap_days": ("a DATE, b DATE, c DATE, d DATE", "INT", "greatest(datediff(least(b, d), greatest(a, c)), 0)"),
    "logit": ("p DOUBLE", "DOUBLE", "CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("merged_intervals", udtf(MergedIntervals))
    spark.udtf.register("interval_days", udtf(IntervalDays, returnType=_DAYS))
    spark.udtf.register("csv_block", udtf(CsvBlock, returnType=_BLOCK))
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
