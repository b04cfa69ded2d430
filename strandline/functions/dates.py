"""Dates, times and ISO durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of_month(when: Column) -> Column:
    """The same time of day on the month's first day."""
    return when - F.make_dt_interval(F.dayofmonth(when) - 1)


def age_years(born: Column, when: Column) -> Column:
    """Whole years between two dates."""
    early = (F.month(when) < F.month(born)) | ((F.month(when) == F.month(born)) & (F.dayofmonth(when) < F.dayofmonth(born)))
    return F.year(when) - F.year(born) - early.cast("int")


def duration_text(seconds: Column) -> Column:
    """Days, hours, minutes and seconds as ``02d 03h 04m 05s``."""
    s = seconds.cast("bigint")
    return F.format_string("%02dd %02dh %02dm %02ds", F.floor(s / 86400), F.pmod(F.floor(s / 3600), F.lit(24)), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def hours_minutes(start: Column, end: Column) -> Column:
    """``H:MM`` between two times, with a sign if they are reversed; N/A if either is missing."""
    minutes = F.timestamp_diff("MINUTE", start, end)
    text = F.format_string("%s%d:%02d", F.when(minutes < 0, "-").otherwise(""), F.floor(F.abs(minutes) / 60), F.pmod(F.abs(minutes), F.lit(60)))
    return F.when(start.isNull() | end.isNull(), "N/A").otherwise(text)


def duration_from_iso(text: Column) -> Column:
    """An ISO-8601 duration as months and seconds (years and months don't come to seconds); null if malformed."""
    part = lambda unit, time: F.coalesce(F.regexp_extract(text, rf"T.*?([0-9.]+){unit}" if time else rf"^-?P(?:[^T]*?[A-Z])?([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    months = (12 * part("Y", False) + part("M", False)).cast("bigint")
    seconds = 604800 * part("W", False) + 86400 * part("D", False) + 3600 * part("H", True) + 60 * part("M", True) + part("S", True)
    good = text.rlike(r"^-?P(?=.)(\d+Y)?(\d+M)?([0-9.]+W)?([0-9.]+D)?(T(?=.)([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?)?$")
    return F.when(good, F.struct((sign * months).alias("months"), (sign * seconds).alias("seconds")))


def duration_to_iso(months: Column, seconds: Column) -> Column:
    """``P{years}Y{months}MT{seconds}S``, the sign in front."""
    minus = (months < 0) | (seconds < 0)
    return F.concat(F.when(minus, "-").otherwise(""), F.lit("P"), F.floor(F.abs(months) / 12), F.lit("Y"), F.pmod(F.abs(months), F.lit(12)), F.lit("MT"), F.abs(seconds), F.lit("S"))


def parse_datetime(text: Column, *formats: str) -> Column:
    """The first of several formats that fits (default: ISO); null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.try_to_timestamp(text))


def parse_date(text: Column, *formats: str) -> Column:
    return F.to_date(parse_datetime(text, *formats))


def to_utc(when: Column, zone: str) -> Column:
    """Wall time of a zone as UTC wall time, both without zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), when)


def from_utc(when: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), when)


def iso_to_utc(text: Column) -> Column:
    """An ISO-8601 text with an offset as UTC wall time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def excel_datetime(serial: Column) -> Column:
    """A spreadsheet's day number as a time."""
    return F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(F.floor(serial).cast("int"), secs=F.round((serial - F.floor(serial)) * 86400, 6).cast("decimal(18,6)"))


def utc_micros(local: Column, zone: str) -> Column:
    """A time of a zone as it is kept: UTC, without a zone, to the microsecond."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))


def from_utc_micros(kept: Column, zone: str) -> Column:
    """A time that is kept so, in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), kept)
