"""Interval algebra on rows (keys, start, end): an interval list is the rows of one key.

Starts and ends are ``timestamp_ntz``; durations come out in seconds (double where fractions matter, else long). Columns
that hold an interval's ends are named by ``start`` and ``end`` arguments, keys by a list of column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "start", "end"
#: Seconds in each unit of ``in_units``.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "y": 31556925.9747}
DAY_START_HOUR, DAY_END_HOUR = 7, 19


def seconds(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds between two times, as seconds."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def whole_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two times, rounded down, as long."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000)).cast("long")


def in_units(duration: Column, unit: str) -> Column:
    """Seconds in another unit; an unknown unit is an error."""
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown unit {unit!r}")
    return duration / F.lit(UNIT_SECONDS[unit])


def ordered(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Ends swapped where reversed; rows without both ends are an error when read."""
    return df.withColumns({start: F.least(start, end), end: F.greatest(start, end)})


def shifted(df: DataFrame, by: Column, start: str = START, end: str = END) -> DataFrame:
    """Both ends moved by an interval column."""
    return df.withColumns({start: F.col(start) + by, end: F.col(end) + by})


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The two share time; touching is not enough."""
    return (a0 < b1) & (a1 > b0)


def contiguous(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The two share time or touch."""
    return (a0 <= b1) & (a1 >= b0)


def contains(a0: Column, a1: Column, when: Column, inclusive: bool = True) -> Column:
    return (a0 <= when) & (when <= a1) if inclusive else (a0 < when) & (when < a1)


def within(a0: Column, a1: Column, b0: Column, b1: Column, inclusive: bool = True) -> Column:
    """a lies inside b."""
    return (b0 <= a0) & (a1 <= b1) if inclusive else (b0 < a0) & (a1 < b1)


def hull(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.struct(F.least(a0, b0).alias(START), F.greatest(a1, b1).alias(END))


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common part: null if apart, of no length if touching."""
    return F.when(contiguous(a0, a1, b0, b1), F.struct(F.greatest(a0, b0).alias(START), F.least(a1, b1).alias(END)))


def cut(a0: Column, a1: Column, times: Column) -> Column:
    """An array of the parts between the ends and those of ``times`` (an array) strictly inside."""
    inside = F.array_sort(F.array_distinct(F.filter(times, lambda t: (t > a0) & (t < a1))))
    points = F.concat(F.array(a0), inside, F.array(a1))
    return F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias(START), F.get(points, i).alias(END)))


def coalesce(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END, touching: bool = True) -> DataFrame:
    """Overlapping (and, unless told otherwise, touching) intervals of a key merged; adds n, the intervals in each."""
    by_start = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) > reach) if touching else (F.col(start) >= reach)
    island = F.sum(F.when(apart, 1).otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def any_overlap(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END, touching: bool = False) -> DataFrame:
    """Per key, whether any two intervals overlap (or touch)."""
    by_start = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    met = reach >= F.col(start) if touching else reach > F.col(start)
    return df.withColumn("_met", F.coalesce(met, F.lit(False))).groupBy(*keys).agg(F.bool_or("_met").alias("any_overlap"))


def gaps(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """Times between consecutive intervals of coalesced input."""
    by_start = Window.partitionBy(*keys).orderBy(start, end)
    found = df.select(*keys, F.col(end).alias("_from"), F.lead(start).over(by_start).alias("_to")).filter("_to is not null")
    return found.select(*keys, F.least("_from", "_to").alias(start), F.greatest("_from", "_to").alias(end))


def extent(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """First start, last end and summed duration (overlaps count twice) of each key."""
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end), F.sum(whole_seconds(start, end)).alias("total_seconds"))


def longest_and_shortest(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """Of each key the longest and shortest interval; the earliest of equals."""
    d = whole_seconds(start, end)
    early = F.struct((-d).alias("d"), F.col(start).alias("s"), F.col(end).alias("e"))
    short = F.struct(d.alias("d"), F.col(start).alias("s"), F.col(end).alias("e"))
    out = df.groupBy(*keys).agg(F.min(early).alias("l"), F.min(short).alias("s"))
    return out.select(*keys, (-F.col("l.d")).alias("longest_seconds"), F.col("l.s").alias("longest_start"), F.col("s.d").alias("shortest_seconds"), F.col("s.s").alias("shortest_start"))


def shortest_gap(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """Of each key the shortest gap (the earliest of equals) and its seconds; keys without gaps are left out."""
    found = gaps(df, keys, start, end).withColumn("_d", whole_seconds(start, end))
    least = found.groupBy(*keys).agg(F.min(F.struct("_d", F.col(start).alias("s"), F.col(end).alias("e"))).alias("g"))
    return least.select(*keys, F.col("g.s").alias(start), F.col("g.e").alias(end), F.col("g._d").alias("seconds"))


def gap_subset(df: DataFrame, keys: Sequence[str], lower: Column, upper: Column, flexibility: int = 2, start: str = START, end: str = END) -> DataFrame:
    """``subset`` of the gaps of coalesced input."""
    return subset(gaps(df, keys, start, end), lower, upper, flexibility, start, end)


def first_starting(df: DataFrame, keys: Sequence[str], when: Column, start: str = START, end: str = END) -> DataFrame:
    """Of each key the first interval (by its end) that starts at a time."""
    return df.filter(F.col(start) == when).groupBy(*keys).agg(F.min(end).alias(end)).select(*keys, when.alias(start), end)


def first_ending(df: DataFrame, keys: Sequence[str], when: Column, start: str = START, end: str = END) -> DataFrame:
    """Of each key the first interval (by its start) that ends at a time."""
    return df.filter(F.col(end) == when).groupBy(*keys).agg(F.min(start).alias(start)).select(*keys, start, when.alias(end))


def whole_day(day: Column) -> Column:
    """From the day's midnight to the next."""
    return day_span(day, F.date_add(day, 1), include_end=False)


def day_span(first: Column, last: Column, include_end: bool = True) -> Column:
    """From the first day's midnight to the end (or, without it, the start) of the last; null if reversed, or if both are one
    day and its end is included."""
    low, high = first.cast("date").cast("timestamp_ntz"), F.date_add(last, 1 if include_end else 0).cast("timestamp_ntz")
    return F.when((first < last) | F.lit(not include_end) & (first == last), F.struct(low.alias(START), high.alias(END)))


def day_time(day: Column, daybreak: int = DAY_START_HOUR, nightfall: int = DAY_END_HOUR) -> Column:
    """From daybreak to nightfall of a day."""
    at = lambda hour: day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    return F.struct(at(daybreak).alias(START), at(nightfall).alias(END))


def is_saturday(day: Column) -> Column:
    return F.weekday(day) == 5


def is_sunday(day: Column) -> Column:
    return F.weekday(day) == 6


def saturday_of_weekend(day: Column) -> Column:
    """The Saturday of the weekend that a day belongs to; null on weekdays."""
    return F.when(is_saturday(day), day).when(is_sunday(day), F.date_sub(day, 1))


def pair_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = START, end: str = END, touching: bool = True, bucket: str = "1 day") -> DataFrame:
    """Intersections of the intervals of two lists with equal keys.

    Both sides are dealt to buckets of time so that a key with many intervals meets only neighbours; a pair is kept in
    the bucket where its common part begins.
    """
    span = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp_ntz'1970-01-01' + interval {bucket})")
    number = lambda c: F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / span).cast("long")
    dealt = lambda df, s, e: df.select(*keys, F.col(start).alias(s), F.col(end).alias(e)).withColumn("_bucket", F.explode(F.sequence(number(F.col(s)), number(F.col(e)))))
    met = dealt(left, "_s1", "_e1").join(dealt(right, "_s2", "_e2"), [*keys, "_bucket"])
    a = [F.col(c) for c in ("_s1", "_e1", "_s2", "_e2")]
    met = met.filter((contiguous if touching else overlaps)(*a) & (number(F.greatest("_s1", "_s2")) == F.col("_bucket")))
    return met.select(*keys, F.greatest("_s1", "_s2").alias(start), F.least("_e1", "_e2").alias(end))


def subset(df: DataFrame, lower: Column, upper: Column, flexibility: int = 2, start: str = START, end: str = END) -> DataFrame:
    """Intervals inside [lower, upper] and off its ends (0), overlapping it (1), or overlapping or touching it (2)."""
    a0, a1 = F.col(start), F.col(end)
    test = {0: within(a0, a1, lower, upper, inclusive=False), 1: overlaps(a0, a1, lower, upper), 2: contiguous(a0, a1, lower, upper)}
    if flexibility not in test:
        raise ValueError("flexibility is 0, 1 or 2")
    return df.filter(test[flexibility])


def by_day(df: DataFrame, start: str = START, end: str = END, day: str = "day") -> DataFrame:
    """A row for each date that an interval touches, with its part of that date as _from and _to."""
    out = df.withColumn(day, F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))))
    midnight = F.col(day).cast("timestamp_ntz")
    return out.withColumns({"_from": F.greatest(F.col(start), midnight), "_to": F.least(F.col(end), midnight + F.expr("interval 1 day"))})


def _in_hours(first: int, last: int, day: str = "day") -> Column:
    """Seconds of the day's part that lie between two hours."""
    midnight = F.col(day).cast("timestamp_ntz")
    low, high = (midnight + F.expr(f"interval {h} hour") for h in (first, last))
    return F.greatest(whole_seconds(F.greatest(F.col("_from"), low), F.least(F.col("_to"), high)), F.lit(0))


def day_night(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END, daybreak: int = DAY_START_HOUR, nightfall: int = DAY_END_HOUR) -> DataFrame:
    """Seconds of each key by day and by night."""
    days = by_day(df, start, end).select(*keys, whole_seconds("_from", "_to").alias("_all"), _in_hours(daybreak, nightfall).alias("_day"))
    return days.groupBy(*keys).agg(F.sum("_day").alias("day_seconds"), F.sum(F.col("_all") - F.col("_day")).alias("night_seconds"))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def is_working_day(day: Column, holiday: Column) -> Column:
    return ~is_weekend(day) & ~holiday


def outside_hours(df: DataFrame, keys: Sequence[str], holidays: DataFrame, start: str = START, end: str = END, first: int = DAY_START_HOUR, last: int = DAY_END_HOUR, days: str = "all") -> DataFrame:
    """Seconds of each key outside working hours. ``holidays`` has a date column ``day``; weekends and holidays are all outside.

    days: all, or only the part on working days (weekdays) or on the others (weekends).
    """
    if days not in ("all", "weekdays", "weekends"):
        raise ValueError("days is all, weekdays or weekends")
    off = holidays.select(F.col("day"), F.lit(True).alias("_off")).distinct()
    met = by_day(df, start, end).join(off, "day", "left")
    working = is_working_day(F.col("day"), F.coalesce("_off", F.lit(False)))
    whole = whole_seconds("_from", "_to")
    outside = F.when(working, F.lit(0) if days == "weekends" else whole - _in_hours(first, last)).otherwise(F.lit(0) if days == "weekdays" else whole)
    return met.select(*keys, outside.alias("_outside")).groupBy(*keys).agg(F.sum("_outside").alias("outside_seconds"))


def weekends(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """Number of weekends that each key's intervals touch."""
    days = by_day(df, start, end).filter(is_weekend(F.col("day")))
    saturday = F.date_sub("day", F.when(F.weekday("day") == 6, 1).otherwise(0))
    touched = days.select(*keys, saturday.alias("_saturday")).groupBy(*keys).agg(F.count_distinct("_saturday").alias("n_weekends"))
    return df.select(*keys).distinct().join(touched, list(keys), "left").select(*keys, F.coalesce("n_weekends", F.lit(0)).cast("long").alias("n_weekends"))


def consecutive_days(df: DataFrame, keys: Sequence[str], start: str = START, end: str = END) -> DataFrame:
    """The longest run of dates that each key's intervals touch, and its first date (the earliest of equals)."""
    days = by_day(df, start, end).select(*keys, "day").distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    runs = days.withColumn("_run", run).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"))
    best = runs.groupBy(*keys).agg(F.min(F.struct((-F.col("n_days")).alias("n"), F.col("first_day").alias("d"))).alias("b"))
    return best.select(*keys, (-F.col("b.n")).alias("n_days"), F.col("b.d").alias("first_day"))


def sufficient_gaps(df: DataFrame, keys: Sequence[str], every_n_days: int, required_seconds: Sequence[int], start: str = START, end: str = END) -> DataFrame:
    """Whether every span of n days has the gaps asked for, longest against longest; gaps that touch a span count.

    Spans begin on each date from the first start on while more than n days are left; a shorter list is one span. Fewer
    than two intervals never suffice. ``df`` is coalesced.
    """
    need = sorted(required_seconds, reverse=True)
    ends = df.groupBy(*keys).agg(F.to_date(F.min(start)).alias("_first"), F.to_date(F.max(end)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    days = F.date_diff("_last", "_first") + 1
    short = days <= every_n_days
    spans = ends.filter("_n > 1").withColumn("_k", F.explode(F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), days - every_n_days - 1))))
    low = F.date_add("_first", F.col("_k"))
    high = F.date_add(F.when(short, F.col("_last")).otherwise(F.date_add("_first", F.col("_k") + every_n_days)), 1)
    spans = spans.select(*keys, "_k", low.cast("timestamp_ntz").alias("_low"), high.cast("timestamp_ntz").alias("_high"))
    free = gaps(df, keys, start, end).select(*keys, F.col(start).alias("_g0"), F.col(end).alias("_g1"))
    free = free.filter(whole_seconds("_g0", "_g1") >= min(need, default=0))  # shorter ones never count
    block = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / every_n_days)
    blocks = lambda df, a, b: df.withColumn("_block", F.explode(F.sequence(block(a), block(b))))
    pairs = blocks(spans, "_low", "_high").join(blocks(free, "_g0", "_g1"), [*keys, "_block"])  # neighbours in time only
    touch = contiguous(F.col("_g0"), F.col("_g1"), F.col("_low"), F.col("_high")) & (F.greatest(block("_low"), block("_g0")) == F.col("_block"))
    met = spans.select(*keys, "_k").join(pairs.filter(touch).select(*keys, "_k", "_g0", "_g1"), [*keys, "_k"], "left")
    touch = F.col("_g0").isNotNull()
    longest = F.sort_array(F.collect_list(F.when(touch, whole_seconds("_g0", "_g1"))), asc=False)
    lists = met.groupBy(*keys, "_k").agg(longest.alias("_d"))
    good = F.size("_d") >= len(need)
    for i, s in enumerate(need):
        good = good & F.coalesce(F.get("_d", F.lit(i)) >= s, F.lit(False))
    each = lists.select(*keys, good.alias("_good")).groupBy(*keys).agg(F.bool_and("_good").alias("_good"))
    return ends.select(*keys).join(each, list(keys), "left").select(*keys, F.coalesce("_good", F.lit(False)).alias("sufficient"))
