"""Whole columns of a table at once: conversions, names, replacements, null values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def converted(df: DataFrame, columns: Sequence[str], how: Callable[[Column], Column]) -> DataFrame:
    """``df`` with a conversion applied to each of the columns."""
    return df.withColumns({c: how(F.col(f"`{c}`")) for c in columns})


def renamed(df: DataFrame, names: dict[str, str | None]) -> DataFrame:
    """Columns under new names, in their old places; a column whose new name is None goes, and unknown names are an error."""
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"no columns {missing}")
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if names.get(c, c) is not None])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with a prefix to their names."""
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def null_values(df: DataFrame, values: Sequence) -> DataFrame:
    """Nulls instead of the values that stand for one, in columns of their type."""
    kinds = {str: ("string",), bool: ("boolean",), int: ("tinyint", "smallint", "int", "bigint"), float: ("float", "double")}
    out = {}
    for c, kind in df.dtypes:
        own = [v for v in values if kind in kinds[type(v)]]
        if own:
            out[c] = F.when(~F.col(f"`{c}`").isin(own), F.col(f"`{c}`"))
    return df.withColumns(out) if out else df


def replaced(df: DataFrame, column: str, old, new) -> DataFrame:
    """One value of a column for another; nulls count as a value."""
    return df.withColumn(column, F.when(F.col(f"`{column}`").eqNullSafe(F.lit(old)), F.lit(new)).otherwise(F.col(f"`{column}`")))


def wiped(df: DataFrame, column: str) -> DataFrame:
    """The column without its values."""
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def described(df: DataFrame) -> DataFrame:
    """Rows (place, name, type, nullable) of the columns."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, nullable boolean")


def profiled(df: DataFrame) -> DataFrame:
    """Rows (place, name, type, n, nulls, values) of the columns: how many rows, nulls and values each has, in one pass."""
    each = [
        F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), F.count_distinct(F.col(f"`{f.name}`")).alias("values"))
        for k, f in enumerate(df.schema)
    ]
    return df.agg(F.array(*each).alias("_c")).select(F.inline("_c"))


def same_columns(a: DataFrame, b: DataFrame, with_names: bool = True) -> bool:
    """Whether two tables have columns of equal types, in order, and of equal names in any case."""
    key = lambda df: [(n.lower() if with_names else "", t) for n, t in df.dtypes]
    return key(a) == key(b)


def create_statement(df: DataFrame, table: str) -> str:
    """A CREATE TABLE statement of the columns."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema)
    return f"CREATE TABLE `{table}` ({own})"


def where_all(df: DataFrame, **criteria: bool) -> DataFrame:
    """Rows whose truth values are all as asked."""
    out = df
    for c, wanted in criteria.items():
        out = out.filter(F.col(f"`{c}`") == F.lit(wanted))
    return out


def merged_maps(key: str, value: str, *tables: DataFrame) -> DataFrame:
    """Rows (key, value) of several tables; of equal keys the later table's, and in one table the smallest."""
    every = None
    for k, t in enumerate(tables):
        own = t.select(F.col(key), F.col(value), F.lit(-k).alias("_n"))
        every = own if every is None else every.union(own)
    return every.groupBy(key).agg(F.min(F.struct("_n", value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value))


def reversed_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values as keys; of keys with one value the largest."""
    return df.groupBy(F.col(value).alias("_v")).agg(F.max(key).alias("_k")).select(F.col("_v").alias(key), F.col("_k").alias(value))
