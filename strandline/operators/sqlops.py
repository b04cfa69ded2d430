"""Small SQL helpers on tables: counts, existence, first values, upsert, get-or-create, merging tables with new keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.columns import create_statement
from strandline.operators.storage import ended


def _all(criteria: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in criteria:
        out = out & c
    return out


def count_star(df: DataFrame, *criteria: Column) -> int:
    """Rows that meet all criteria."""
    return df.filter(_all(criteria)).count()


def count_and_max(df: DataFrame, column: str, *criteria: Column) -> DataFrame:
    """One row: count and largest value (null if there are none), in one pass."""
    return df.filter(_all(criteria)).agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("largest"))


def exists(df: DataFrame, *criteria: Column) -> bool:
    return bool(df.filter(_all(criteria)).limit(1).count())


def exists_flag(df: DataFrame, *criteria: Column) -> DataFrame:
    """One row: 1 if any row meets all criteria, else 0."""
    found = df.filter(_all(criteria)).select(F.lit(1).alias("x")).limit(1)
    return found.agg(F.count(F.lit(1)).cast("int").alias("found"))


def first_column(df: DataFrame) -> DataFrame:
    """The first column as ``value``."""
    return df.select(F.col(f"`{df.columns[0]}`").alias("value"))


def first_values(df: DataFrame) -> list:
    """All values of the first column, for results that fit the driver."""
    return [r[0] for r in first_column(df).toLocalIterator()]


def rows_and_names(spark: SparkSession, sql: str, **args) -> tuple[list, list[str]]:
    """Rows and column names of a statement, for results that fit the driver."""
    if not isinstance(sql, str):
        raise ValueError("SQL must be text")
    df = spark.sql(sql, args=args or None)
    return df.collect(), df.columns


def statement(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A statement's rows, under its names, as a table: nothing passes the driver. ``tables`` stand in it as {name}, ``args`` as :name."""
    if not isinstance(sql, str):
        raise ValueError("SQL must be text")
    return spark.sql(sql, args=args or None, **(tables or {}))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys or are added; columns that ``new`` lacks stay.

    Of several new rows with one key the largest counts (as a struct of the columns, in the old table's order).
    """
    value = [c for c in old.columns if c not in key and c in new.columns]
    fresh = new.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max(F.struct(*value)).alias("_new"))
    test = F.lit(True)
    for k in key:
        test = test & (F.col(k) == F.col(f"_{k}"))
    met = old.join(fresh, test, "full_outer")
    given = F.col(f"_{key[0]}").isNotNull()
    out = [F.coalesce(k, f"_{k}").alias(k) if k in key else F.when(given, F.col(f"_new.{k}")).otherwise(F.col(k)).alias(k) if k in value else F.col(k) for k in old.columns]
    return met.select(*out)


def get_or_create(table: DataFrame, wanted: DataFrame, key: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """A row of ``table`` for each distinct key in ``wanted``, made from the defaults where there is none; adds created."""
    keys = wanted.select(*key).distinct()
    found = table.join(keys, list(key), "left_semi").withColumn("created", F.lit(False))
    missing = keys.join(table, list(key), "left_anti")
    made = missing.select(*[F.col(c) if c in key else F.lit(defaults.get(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns], F.lit(True).alias("created"))
    return found.unionByName(made)


def new_keys(source: DataFrame, key: str, above: int) -> DataFrame:
    """Rows (old_key, new_key): new integers after ``above``, without gaps, in the order of the old keys."""
    keys = source.select(F.col(key).alias("old_key")).filter("old_key is not null").distinct()
    return running_sum(keys, ["old_key"], F.lit(1), "_n").select("old_key", (F.col("_n") + above).cast("long").alias("new_key"))


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, in order.

    Sums are made within ranges of the order and offset by the sums of the ranges before (a row for each of Spark's
    shuffle partitions), so no single task sorts all rows.
    """
    ranged = ended(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum("_value").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(offsets, "_part").select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def merge_tables(target: DataFrame, source: DataFrame, key: str, references: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``source`` added to ``target`` under new keys. Returns the merged table and the key map (old_key, new_key).

    references: for each column of ``source`` that points to a table merged before, that table's key map. Parents go
    first; columns that ``source`` lacks become null.
    """
    above = target.agg(F.max(key)).first()[0] or 0
    keys = new_keys(source, key, above)
    moved = source.join(keys, F.col(key) == F.col("old_key")).drop(key, "old_key").withColumnRenamed("new_key", key)
    for column, known in (references or {}).items():
        to = known.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
        moved = moved.join(to, F.col(column) == F.col("_old"), "left").drop(column, "_old").withColumnRenamed("_new", column)
    return target.unionByName(moved.select(*[c for c in target.columns if c in moved.columns]), allowMissingColumns=True), keys


def table_order(parents: dict[str, Sequence[str]]) -> list[list[str]]:
    """Layers of table names such that each table's parents (itself apart) come in an earlier layer; rings are an error."""
    left = {t: {p for p in ps if p != t} for t, ps in parents.items()}
    out: list[list[str]] = []
    while left:
        layer = sorted(t for t, ps in left.items() if not ps & set(left))
        if not layer:
            raise ValueError(f"tables depend on each other: {sorted(left)}")
        out.append(layer)
        left = {t: ps for t, ps in left.items() if t not in layer}
    return out


def union_checked(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns must be the same, in name and order."""
    for t in tables[1:]:
        if t.columns != tables[0].columns:
            raise ValueError(f"columns {t.columns} are not {tables[0].columns}")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """Each row as an INSERT statement: a column ``statement``."""
    return df.select(_insert(df, table).alias("statement"))


def _insert(df: DataFrame, table: str) -> Column:
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    plain = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    values = [F.coalesce(F.col(f"`{c}`").cast("string") if t in plain or t.startswith("decimal") else quoted(F.col(f"`{c}`").cast("string")), F.lit("NULL")) for c, t in df.dtypes]
    names = ", ".join(f"`{c}`" for c in df.columns)
    return F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES ("), F.concat_ws(", ", *values), F.lit(");"))


def dump_script(df: DataFrame, table: str, order: Sequence[str]) -> DataFrame:
    """Rows (place, statement) of a script that makes the table and its rows, in order: place 0 is the CREATE statement."""
    first = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(create_statement(df, table) + ";").alias("statement"))
    return first.union(running_sum(df, order, F.lit(1), "_place").select(F.col("_place").cast("long"), _insert(df, table)))


def require_same(df: DataFrame, key: Sequence[str], columns: Sequence[str], ignore_null: bool = False) -> DataFrame:
    """Keys whose rows differ in a column that should be constant: rows (keys, column name, values found)."""
    out = None
    for c in columns:
        kinds = F.count_distinct(c) + (F.lit(0) if ignore_null else F.max(F.col(c).isNull().cast("int")))
        bad = df.groupBy(*key).agg(kinds.alias("_n"), F.sort_array(F.collect_set(F.col(c).cast("string"))).alias("found")).filter("_n > 1").select(*key, F.lit(c).alias("column"), "found")
        out = bad if out is None else out.union(bad)
    return out
