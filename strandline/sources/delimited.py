"""Delimited and plain text files, spreadsheets' cells, listings of files; writers for text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.convert import nulls
from strandline.functions.dates import excel_datetime
from strandline.functions.strings import tsv_escape, without_comment
from strandline.operators.sqlops import union_checked


def merge_csv(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Rows of delimited files whose headers must all be the first one's."""
    return union_checked(*[spark.read.csv(p, header=True, sep=sep) for p in paths])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line) of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_code_lines(spark: SparkSession, path: str, at_start_only: bool = False) -> DataFrame:
    """Lines without comments and blank lines."""
    return read_lines(spark, path).withColumn("line", without_comment(F.col("line"), at_start_only)).filter("line is not null")


def has_line(spark: SparkSession, path: str, line: str) -> bool:
    return bool(spark.read.text(path).filter(F.col("value") == line).limit(1).count())


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (path, modified, size) of the files under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of one listing that an earlier one lacks or has with another time."""
    return now.join(before.select(F.col("path").alias("_p"), F.col("modified").alias("_m")), (F.col("path") == F.col("_p")) & (F.col("modified") == F.col("_m")), "left_anti")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header; tabs and line feeds are escaped and nulls are empty."""
    df.select(*[tsv_escape(F.col(c)).alias(c) for c in df.columns]).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_gzipped_text(df: DataFrame, path: str) -> None:
    """One string column as compressed text files."""
    df.write.option("compression", "gzip").text(path)


def cell(value: Column, kind: str, null_values: Sequence[str] = (), default=None) -> Column:
    """A spreadsheet cell read as text, as one of: str, int, float, bool, date, datetime, decimal; blank is the default.

    Whole numbers only for int; dates are ISO texts or day numbers; anything else is an error.
    """
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    if null_values:
        text = nulls(text, null_values)
    number = text.try_cast("double")
    wrong = F.raise_error(F.concat(F.lit(f"not {kind}: "), text))
    when = F.when(number.isNotNull(), excel_datetime(number)).otherwise(F.try_to_timestamp(text).cast("timestamp_ntz"))
    forms = {
        "str": (text, "string"),
        "int": (F.when(number == F.floor(number), number.cast("bigint")), "bigint"),
        "float": (number, "double"),
        "bool": (F.when(F.lower(text).isin("y", "yes", "t", "true", "1"), True).when(F.lower(text).isin("n", "no", "f", "false", "0"), False), "boolean"),
        "date": (when.cast("date"), "date"),
        "datetime": (when, "timestamp_ntz"),
        "decimal": (text.try_cast("decimal(38,10)"), "decimal(38,10)"),
    }
    out, sql_type = forms[kind]
    return F.when(text.isNull(), F.lit(default).cast(sql_type)).when(out.isNull(), wrong.cast(sql_type)).otherwise(out)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, if its columns are these, in this order."""
    if list(df.columns) != list(columns):
        raise ValueError(f"columns {df.columns} are not {list(columns)}")
    return df
