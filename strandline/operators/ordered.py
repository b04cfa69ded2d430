"""Joins by order: the row last before or next after a time (as-of), and the range that a value lies in.

Both merge two sorted sides and carry the last row of one side forward to rows of the other, within slices of bounded size:
no pair is tested that isn't met, nothing large is broadcast, and neither a hot key nor a hot value stays in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.storage import ended

#: Ends of ranges in a slice, and rows that meet a slice in one share of it.
SLICE_CUTS, SHARE_ROWS = 100_000, 1_000_000
#: Rows of a key from which it is cut by time (more, where that would be more than ``HOT_KEYS`` keys), and into how many slices.
HOT_ROWS, HOT_KEYS, HOT_SLICES = 1_000_000, 10_000, 200
#: Pieces up to which a list is written into the plan.
LITERALS = 64
#: Levels of halving that are settled in one step.
STRIDE = 5


def with_count_upto(df: DataFrame, name: str, bounds: str, value: str, most: int) -> DataFrame:
    """``df`` with how many items of the sorted array ``bounds`` (``most`` at most) are <= ``value``, by halving. Null: none."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))))
    halve = lambda at, step: F.when(F.get(F.col(bounds), at + step - 1) <= F.col(value), at + step).otherwise(at)
    return df.withColumn(name, F.aggregate(steps, F.lit(0), halve))


def sweep(ranges: Sequence[tuple]) -> list[tuple]:
    """Pieces (low, high, label) without overlaps, in order, of few ranges (ordinal, low, high, label): the first by ordinal
    (then label) has what several cover."""
    begins = sorted((r for r in ranges if r[0] is not None and r[1] is not None and r[2] is not None and r[1] < r[2]), key=lambda r: r[1])
    cuts = sorted({x for r in begins for x in r[1:3]})
    out, over, at = [], [], 0
    for low, high in zip(cuts, cuts[1:]):
        while at < len(begins) and begins[at][1] <= low:
            ordinal, _, end, label = begins[at]
            heapq.heappush(over, ((ordinal, label is not None, label), at, end))
            at += 1
        while over and over[0][2] <= low:
            heapq.heappop(over)
        if over:
            out.append((low, high, over[0][0][2]))
    return out


def pieces(ranges: DataFrame) -> DataFrame:
    """``sweep`` for any number of ranges: rows (slice, low, high, label).

    Slices of about ``SLICE_CUTS`` ends each follow each other in order. A range that leaves its slice is one part in the slice of
    its low, one in that of its high, and covers those between whole; of equal parts the first by ordinal stays, so a slice has
    few more parts than ends. Each slice is swept by itself: work grows with the ranges, not with what they cover.
    """
    first = F.min(F.struct("ordinal", "label")).alias("first")
    own = ranges.filter("ordinal IS NOT NULL AND low IS NOT NULL AND low < high")
    ends = own.select(F.explode(F.array("low", "high")).alias("at"))
    kind = ends.schema["at"].dataType
    own = own.withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})
    slices = max(1, -(-2 * own.count() // SLICE_CUTS))
    begins = ends.repartitionByRange(slices, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("low"))
    begins = ended(begins.agg(F.sort_array(F.collect_list("low")).alias("bounds")))
    count, bounds = begins.select(F.size("bounds")).first()[0], begins.scalar()
    met = with_count_upto(with_count_upto(own.withColumn("bounds", bounds), "a", "bounds", "low", count), "b", "bounds", "high", count)
    parts = met.select(F.explode(F.expr(_PARTS)).alias("part"), "ordinal", "label").groupBy("part.slice", "part.low", "part.high").agg(first)
    crossing = met.filter("b - a > 1").groupBy(F.col("a").cast("long").alias("a"), (F.col("b") - 1).cast("long").alias("b")).agg(first)
    node = F.col("node").cast("int")  # slice k + 1 begins at bound k, from 0
    whole = _covered(crossing, count).select((node + 1).alias("slice"), F.get(bounds, node).alias("low"), F.get(bounds, node + 1).alias("high"), "first")
    parts = parts.unionByName(whole).withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy("first")))
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind), ranges.schema["label"]])
    return parts.select("slice", "low", "high", "place", "first.label").groupBy("slice").applyInArrow(_swept, schema)


#: The parts of a range in the slices of its ends, a and b (slice k begins at the k-th of the bounds, from 1).
_PARTS = """if(a = b, array(named_struct('slice', a, 'low', low, 'high', high)), filter(array(
    named_struct('slice', a, 'low', low, 'high', get(bounds, a)),
    named_struct('slice', b, 'low', get(bounds, b - 1), 'high', high)), x -> x.low < x.high))"""


def _swept(parts: pa.Table) -> pa.Table:
    """The pieces of one slice, whose parts have numbers in order of their ordinals and labels. Ends are compared by their ranks."""
    ends = pa.chunked_array([*parts["low"].chunks, *parts["high"].chunks]).combine_chunks()
    ranks = pc.rank(ends, tiebreaker="dense").to_pylist()
    at = {rank: i for i, rank in enumerate(ranks)}
    found = sweep(list(zip(parts["place"].to_pylist(), ranks, ranks[len(parts) :], range(len(parts)))))
    low, high, label = zip(*found)
    columns = [parts["slice"].take([0] * len(found)), ends.take([at[x] for x in low]), ends.take([at[x] for x in high]), parts["label"].take(list(label))]
    return pa.table(columns, ["slice", "low", "high", "label"])


def _covered(spans: DataFrame, count: int) -> DataFrame:
    """Rows (node, first): of each number under ``count`` the first of the spans [a, b) of numbers (a, b, first) that hold it.

    A span is a few aligned blocks of a power of two; each block keeps its first, and blocks hand theirs down to what they are
    made of, several levels at a time.
    """
    blocks = spans.select("first", F.explode(F.expr(_BLOCKS)).alias("block")).groupBy("block.level", "block.node").agg(F.min("first").alias("first"))
    blocks, held = ended(blocks), None
    for base in reversed(range(0, max(1, count.bit_length()), STRIDE)):
        here = blocks.filter((F.col("level") >= base) & (F.col("level") < base + STRIDE))
        below = _handed_down(here, f"CAST(level - {base} AS INT)")
        if held is not None:
            below = below.union(_handed_down(held, str(STRIDE)))
        held = below.filter(F.col("node") * (1 << base) < count).groupBy("node").agg(F.min("first").alias("first"))
    return held


#: The aligned blocks that [a, b) is made of: at each level its first number where that is odd, its last where that is even.
_UP, _DOWN = "shiftright(a + shiftleft(1L, k) - 1, k)", "shiftright(b, k)"
_BLOCKS = f"""filter(flatten(transform(sequence(0, length(bin(b - a)) - 1), k -> array(
    if({_UP} < {_DOWN} AND {_UP} % 2 = 1, named_struct('level', k, 'node', {_UP}), null),
    if({_UP} < {_DOWN} AND {_DOWN} % 2 = 1, named_struct('level', k, 'node', {_DOWN} - 1), null)))), x -> x IS NOT NULL)"""


def _handed_down(blocks: DataFrame, levels: str) -> DataFrame:
    return blocks.select(F.explode(F.expr(f"sequence(shiftleft(node, {levels}), shiftleft(node + 1, {levels}) - 1)")).alias("node"), "first")


def as_rows(df: DataFrame, value: str) -> DataFrame:
    """Rows (row, at): all of ``df`` as a struct, and the value."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{value}`").alias("at"))


def from_few(df: DataFrame, value: str, ranges: Sequence[tuple], low: T.DataType, label: T.DataType) -> DataFrame:
    """Rows (row, met): every row of ``df`` as a struct, with the struct (low, high, label) of the piece of a few ranges that
    holds its value, or null. The pieces are one sorted array, which every row searches by halving. No join."""
    found = sweep(ranges)
    kind = T.StructType([T.StructField("low", low), T.StructField("high", low), T.StructField("label", label)])
    if len(found) <= LITERALS:
        typed = lambda p: F.struct(F.lit(p[0]).cast(low).alias("low"), F.lit(p[1]).cast(low).alias("high"), F.lit(p[2]).cast(label).alias("label"))
        lists = F.array(*map(typed, found)).cast(T.ArrayType(kind))
    else:
        lists = df.sparkSession.createDataFrame([(found,)], T.StructType([T.StructField("pieces", T.ArrayType(kind))])).scalar()
    rows = as_rows(df, value).withColumn("pieces", lists).withColumn("lows", F.col("pieces.low"))
    rows = with_count_upto(rows, "n", "lows", "at", len(found))
    rows = rows.select("row", "at", F.when(F.col("n") > 0, F.get("pieces", F.col("n") - 1)).alias("met"))
    return rows.select("row", F.when(F.col("at") < F.col("met.high"), F.col("met")).alias("met"))


def from_many(df: DataFrame, value: str, parts: DataFrame) -> DataFrame:
    """``from_few`` with the rows of ``pieces``, however many: both sides are merged in slices.

    Slices are those of the pieces; one that more than ``SHARE_ROWS`` rows meet is copied to as many shares, over which the rows are
    dealt by hash.
    """
    spark = df.sparkSession
    own = ended(parts)
    begins = ended(own.groupBy("slice").agg(F.min("low").alias("low")).agg(F.sort_array(F.collect_list("low")).alias("lows"), F.sort_array(F.collect_list("slice")).alias("slices")))
    begun = begins.first().slices
    bounds = begins.select("lows").scalar()
    rows = with_count_upto(as_rows(df, value).withColumn("bounds", bounds), "slice", "bounds", "at", len(begun)).drop("bounds")
    counts = dict(map(tuple, rows.groupBy("slice").count().collect()))
    shares = [_shares(counts.get(k, 0)) for k in range(len(begun) + 1)]
    dealt = spark.createDataFrame([(shares, begun)], "shares array<int>, begun array<int>")
    many = dealt.select("shares").scalar()
    rows = rows.withColumn("share", F.pmod(_row_hash(df), F.get(many, F.col("slice"))).cast("int"))
    place = F.array_position(dealt.select("begun").scalar(), F.col("slice")).cast("int")
    cuts = own.withColumn("slice", place).withColumn("share", F.explode(F.sequence(F.lit(0), F.get(many, F.col("slice")) - 1)))
    merged = rows.select("slice", "share", "at", F.lit(1).alias("side"), "row", F.lit(None).cast(_PIECE.format(*(parts.schema[c].dataType.simpleString() for c in ("low", "high", "label")))).alias("piece")).union(
        cuts.select("slice", "share", F.col("low").alias("at"), F.lit(0), F.lit(None).cast(T.StructType(df.schema.fields)), F.struct("low", "high", "label"))
    )
    before = Window.partitionBy("slice", "share").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = merged.withColumn("piece", F.last("piece", ignorenulls=True).over(before)).filter("side = 1")
    return met.select("row", F.when(F.col("at") < F.col("piece.high"), F.col("piece")).alias("met"))


_PIECE = "struct<low:{},high:{},label:{}>"


def _shares(rows: int) -> int:
    return max(1, -(-rows // SHARE_ROWS))


def _row_hash(df: DataFrame) -> Column:
    """A hash of a row, of the columns that can be hashed, as struct ``row``."""
    plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    return F.xxhash64(*(F.col("row")[c] for c in plain)) if plain else F.lit(0)


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: Sequence[str] = (), direction: str = "backward", within: Column | None = None, exact: bool = True, met: str = "met", cut: bool = True) -> DataFrame:
    """Every row of ``left`` with the row of ``right``, of the same ``by``, that is last before it, next after it, or nearest.

    ``met`` is that row as a struct without the columns of ``by``, or null: where there is none, it is further away than
    ``within`` (a number, or an interval for times), or a key or time is null. direction: backward, forward or nearest (ties:
    the one before). Rows at the same time count unless ``exact`` is false. Of rows of ``right`` with equal key and time the
    largest (as a struct) is met. Keys with many rows are cut by time, each slice beginning with the row that is last before
    it (ending with the next after it), and slices that many rows of ``left`` meet are copied to shares of these; that takes
    a job that counts keys, which ``cut`` false leaves out where keys are known to be small.
    """
    keys = [f"_k{i}" for i in range(len(by) or 1)]
    named = lambda df, at: [*((F.col(f"`{b}`") if b else F.lit(0)).alias(k) for b, k in zip(by or [None], keys)), F.col(f"`{at}`").alias("_at")]
    rest = [c for c in right.columns if c not in by]
    present = " AND ".join(f"{k} IS NOT NULL" for k in [*keys, "_at"])
    known = right.select(*named(right, right_at), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_met")).filter(present)
    rows = left.select(*named(left, left_at), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row"))
    asked, without = rows.filter(present), rows.filter(f"NOT ({present})")
    place, hot = keys, _hot(asked, known, keys) if cut else None
    if hot is not None:
        place = [*keys, "_slice", "_share"]
        asked, known = _cut(asked, known, keys, hot, direction, _row_hash(left))
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = asked.select(*place, "_at", F.lit(True).alias("_asks"), "row", nothing(known, "_met")).union(known.select(*place, "_at", F.lit(False), nothing(asked, "row"), "_met"))
    marked = F.when(~F.col("_asks"), F.struct("_at", "_met"))
    over = Window.partitionBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_asks") if exact else ~F.col("_asks")
    if direction != "forward":
        both = both.withColumn("_before", F.last(marked, ignorenulls=True).over(over.orderBy("_at", first, "_met")))
    if direction != "backward":
        both = both.withColumn("_after", F.last(marked, ignorenulls=True).over(over.orderBy(F.desc("_at"), first, "_met")))
    if direction == "nearest":
        closer = F.col("_after._at") - F.col("_at") < F.col("_at") - F.col("_before._at")
        near = F.when(F.col("_before").isNull() | closer, F.col("_after")).otherwise(F.col("_before"))
    else:
        near = F.col("_before" if direction == "backward" else "_after")
    both = both.filter("_asks").withColumn("_near", near)
    if within is not None:
        close = (F.col("_near._at") + within >= F.col("_at")) & (F.col("_near._at") - within <= F.col("_at"))
        both = both.withColumn("_near", F.when(close, F.col("_near")))
    found = both.select("row", F.col("_near._met").alias("_met")).union(without.select("row", nothing(known, "_met")))
    return found.select("row.*", F.col("_met").alias(met))


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("_slice", F.lit(0)).withColumn("_share", F.lit(0))


def _hot(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with many rows on both sides together, ``HOT_KEYS`` at most; None if there are none."""
    sizes = asked.select(*keys).union(known.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    return ended(sizes.filter(F.col("_n") > least).select(*keys)) if (largest or 0) > least else None


def _cut(asked: DataFrame, known: DataFrame, keys: list[str], hot: DataFrame, direction: str, row_hash: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with _slice and _share: 0 and 0 but for the hot keys. What is broadcast are ``HOT_SLICES`` rows for each of
    these at most."""
    is_hot = lambda df, how: df.join(F.broadcast(hot), keys, how)
    parts = [k / HOT_SLICES for k in range(1, HOT_SLICES)]
    bounds = is_hot(known, "left_semi").groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_at", parts, 10 * HOT_SLICES)).alias("_bounds"))
    bounds = F.broadcast(ended(bounds))
    slices = lambda df: with_count_upto(df.join(bounds, keys), "_slice", "_bounds", "_at", HOT_SLICES).drop("_bounds")
    one = is_hot(known, "left_semi").groupBy(*keys, "_at").agg(F.max("_met").alias("_met"))
    hot_asked, hot_known = slices(is_hot(asked, "left_semi")), slices(one)
    of_slice = hot_asked.groupBy(*keys, "_slice").agg((F.floor((F.count(F.lit(1)) - 1) / SHARE_ROWS) + 1).cast("int").alias("_shares"))
    of_slice = F.broadcast(ended(of_slice))
    slices_met = hot_asked.select(*keys, "_slice").distinct()
    ends = hot_known
    for pick, order, needed in ((F.max_by, F.asc("_slice"), direction != "forward"), (F.min_by, F.desc("_slice"), direction != "backward")):
        if needed:
            last = hot_known.groupBy(*keys, "_slice").agg(pick(F.struct("_at", "_met"), "_at").alias("_end"))
            past = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
            carried = slices_met.join(last, [*keys, "_slice"], "full_outer").withColumn("_past", past).filter("_past IS NOT NULL")
            ends = ends.unionByName(carried.select(*keys, "_past._at", "_past._met", "_slice"))
    shared = ends.join(of_slice, [*keys, "_slice"]).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    dealt = hot_asked.join(of_slice, [*keys, "_slice"]).withColumn("_share", F.pmod(row_hash, F.col("_shares")).cast("int")).drop("_shares")
    return _whole(is_hot(asked, "left_anti")).unionByName(dealt), _whole(is_hot(known, "left_anti")).unionByName(shared)
