"""Lookups: by range, by list of values, ignoring case, by pattern; differences of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered

#: Rows and bytes of a lookup table that may be broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16_000_000


#: Bytes up to which the plan's own estimate is taken for proof: files may be compressed, so this is well under the bound.
SURE_BYTES = BROADCAST_BYTES // 8


def small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint, if it is known to be small: by the plan's estimate, where that is an upper bound (nothing in
    the plan makes rows of arrays or joins) and far under the limit, else by counting and measuring."""
    plan = table._jdf.queryExecution().optimizedPlan()
    grows = any(word in plan.toString() for word in ("Generate", "Join", "Expand", "Range"))
    if not grows and int(str(plan.stats().sizeInBytes())) <= SURE_BYTES:
        return F.broadcast(table)
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))) if table.columns else F.lit(0)
    rows, size = table.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else table


def map_value(value: Column, rules: Sequence[tuple[Sequence, object]], default=None, pass_null: bool = True, required: bool = False) -> Column:
    """The result of the first rule whose values hold ``value``; else the default, or an error if one is required."""
    none = F.lit(None)
    out = F.when(value.isNull(), none) if pass_null else None
    for values, result in rules:
        test = value.isin([v for v in values if v is not None])
        if any(v is None for v in values):
            test = test | value.isNull()
        out = out.when(test, F.lit(result)) if out is not None else F.when(test, F.lit(result))
    missing = F.raise_error(F.concat(F.lit("no rule for "), value.cast("string"))) if required else F.lit(default)
    return out.otherwise(missing)


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, how: str = "left", few: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` with the label of the first range (by ordinal) with low <= value < high.

    ``ranges`` has ordinal, low, high and label. how: left keeps rows without a range, inner doesn't, semi only tests. Up to
    ``few`` ranges are searched in place, as one sorted array; more are merged with the rows in order.
    """
    own = ranges.select("ordinal", "low", "high", "label")
    held = _few(own, few)
    if held is None:
        found = ordered.from_many(df, value, ordered.pieces(own))
    else:
        found = ordered.from_few(df, value, held, own.schema["low"].dataType, own.schema["label"].dataType)
    if how != "left":
        found = found.filter("met IS NOT NULL")
    return found.select("row.*", *([] if how == "semi" else [F.col("met.label").alias("label")]))


def _few(ranges: DataFrame, few: int) -> list[tuple] | None:
    """The ranges, or None if there are more than ``few`` or their labels are long."""
    size = F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0))
    rows = ranges.withColumn("_size", size).limit(few + 1).collect()
    if len(rows) > few or sum(r["_size"] for r in rows) > BROADCAST_BYTES:
        return None
    return [(r.ordinal, r.low, r.high, r.label) for r in rows]


def disjoint(ranges: DataFrame) -> DataFrame:
    """Rows (low, high, label) without overlaps: each piece between two ends has the label of its first range by ordinal."""
    return ordered.pieces(ranges).drop("slice")


def ci_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """Value of the key that is equal when case is ignored (the first by key of several), and whether there is one."""
    first = table.groupBy(F.lower(table_key).alias("_k")).agg(F.min_by(value, table_key).alias("_value"))
    met = df.join(small(first), F.lower(df[f"`{key}`"]) == F.col("_k"), "left")
    return met.select(*[df[f"`{c}`"] for c in df.columns], F.col("_value").alias("value"), F.col("_k").isNotNull().alias("found"))


def map_keys(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default=None, omit_missing: bool = False) -> DataFrame:
    """Exact lookup: rows with the table's value, a default for missing keys, or without them."""
    known = small(table.select(F.col(table_key).alias("_k"), F.col(value).alias("_value")))
    met = df.join(known, df[f"`{key}`"] == F.col("_k"), "inner" if omit_missing else "left")
    return met.select(*[df[f"`{c}`"] for c in df.columns], F.when(F.col("_k").isNull(), F.lit(default)).otherwise(F.col("_value")).alias("value"))


def regex_classify(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], unknown=None) -> DataFrame:
    """The label of the first pattern that matches at the start of the text, case and line ends ignored."""
    out = F.lit(unknown)
    for pattern, label in reversed(rules):
        out = F.when(F.col(text).rlike(f"(?is)^(?:{pattern})"), F.lit(label)).otherwise(out)
    return df.withColumn("label", out)


def like_any(text: Column, patterns: Sequence[str]) -> Column:
    """Any of several LIKE patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.like(p)
    return out


def regex_to_like(pattern: str, one: str = "_", many: str = "%") -> list[str]:
    """LIKE patterns for a regular expression of literals, ``.``, ``.*``, ``[abc]`` and ``x?``: one for each choice."""
    out, at = [""], 0
    while at < len(pattern):
        if pattern.startswith(".*", at):
            choices, at = [many], at + 2
        elif pattern[at] == "[":
            close = pattern.index("]", at)
            choices, at = list(pattern[at + 1 : close]), close + 1
        else:
            choices, at = [one if pattern[at] == "." else pattern[at]], at + 1
        if at < len(pattern) and pattern[at] == "?":
            choices, at = ["", *choices], at + 1
        out = [o + c for o in out for c in choices]
    return [many + o.strip(many) + many if o.strip(many) else many for o in out]


def table_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What turns one table into another of the same columns: rows (key, change, and the new values), by key.

    change: added, changed or deleted (then the values are null).
    """
    others = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_a"), F.struct(*others).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*others).alias("_new"))
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return met.withColumn("change", change).filter("change is not null").select(F.coalesce("_a", "_b").alias(key), "change", *[F.col(f"_new.{c}").alias(c) for c in others])


def cross_product(*tables: DataFrame) -> DataFrame:
    """All combinations of the rows of small named lists (parameter grids); refused beyond a million rows."""
    total = 1
    for t in tables:
        total *= t.count()
    if total > 1_000_000:
        raise ValueError(f"{total} combinations")
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out


def params_around_centre(spark, **params: Sequence) -> DataFrame:
    """One row for each setting that differs from the centre in one parameter at most; each list's middle is its centre."""
    names = list(params)
    centre = {k: v[len(v) // 2] for k, v in params.items()}
    rows = dict.fromkeys(tuple(v if k == name else centre[k] for k in names) for name in names for v in params[name])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["setting", *names])


def natural_key(text: Column) -> Column:
    """A string that sorts runs of digits by value, however long: leading zeros go and the number of digits comes first."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 9, "0"), bare(p))).otherwise(p)), "")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
