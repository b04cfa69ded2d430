"""A whole database added to another of the same tables, under new keys, with its references kept.

The new keys of a table follow from its old keys alone. So all tables are numbered first and every reference is rewritten by a
join with the map of the table it points to, whatever the order: a table may point to itself, and tables to each other in a ring.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.sqlops import new_keys
from strandline.operators.storage import ended


def merge_database(
    target: dict[str, DataFrame], source: dict[str, DataFrame], keys: dict[str, str], references: dict[tuple[str, str], str],
    translate: Callable[[str, DataFrame], DataFrame | None] | None = None, only: Sequence[str] | None = None, skip: Sequence[str] = (), keep_keys: Sequence[str] = (),
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The merged tables by name, and the key map (old_key, new_key) of each table that was added to.

    ``references`` says which table a column (table, column) points to. Tables of the target that the source lacks, or that
    ``skip`` names or ``only`` doesn't, stay as they are; columns that the source lacks become null. ``translate`` may change
    a source table before it is numbered (leave out rows, change values), or leave it out by returning None. A reference to a row
    that isn't added, or to a table that isn't, becomes null. Tables in ``keep_keys`` keep their keys, which the target must
    not have. Rows with a null key are left out, as nothing could refer to them.
    """
    wrong = [f"{t}.{c}" for (t, c), parent in references.items() if t not in keys or parent not in keys]
    if wrong:
        raise ValueError(f"references of or to tables without a key: {wrong}")
    added: dict[str, DataFrame] = {}
    for name in target:
        if name in source and name not in skip and (only is None or name in only):
            rows = translate(name, source[name]) if translate else source[name]
            if rows is not None:
                added[name] = rows.filter(F.col(keys[name]).isNotNull())
    maps = {name: _key_map(target[name], rows, keys[name], name in keep_keys, name) for name, rows in added.items()}
    merged = dict(target)
    for name, rows in added.items():
        moved = _renamed(rows, keys[name], maps[name], "inner")
        for (own, column), parent in references.items():
            if own == name and column in rows.columns:
                moved = _renamed(moved, column, maps[parent], "left") if parent in maps else moved.withColumn(column, F.lit(None).cast(rows.schema[column].dataType))
        columns = [c for c in target[name].columns if c in moved.columns]
        merged[name] = target[name].unionByName(moved.select(*columns), allowMissingColumns=True)
    return merged, maps


def _key_map(target: DataFrame, rows: DataFrame, key: str, keep: bool, name: str) -> DataFrame:
    if keep:
        clash = rows.join(target.select(F.col(key).alias("_t")), F.col(key) == F.col("_t"), "left_semi").select(key).limit(1).collect()
        if clash:
            raise ValueError(f"{name} keeps its keys, but the target has {clash[0][0]!r} already")
        return rows.select(F.col(key).alias("old_key"), F.col(key).alias("new_key")).distinct()
    return ended(new_keys(rows, key, target.agg(F.max(key)).first()[0] or 0), "keys")


def _renamed(rows: DataFrame, column: str, known: DataFrame, how: str) -> DataFrame:
    """``rows`` with new keys for old ones in a column; the order of columns changes."""
    kind = rows.schema[column].dataType
    to = known.select(F.col("old_key").alias("_old"), F.col("new_key").cast(kind).alias("_new"))
    return rows.join(to, F.col(column) == F.col("_old"), how).drop(column, "_old").withColumnRenamed("_new", column)


def table_layers(parents: dict[str, Sequence[str]]) -> list[list[str]]:
    """Layers of table names such that each table's parents come in an earlier layer, or in its own where they are on a ring."""
    above = {t: set(ps) for t, ps in parents.items()}
    for t in {p for ps in parents.values() for p in ps}:
        above.setdefault(t, set())
    for through in above:
        for ps in above.values():
            if through in ps:
                ps |= above[through]
    depth: dict[str, int] = {}

    def layer(t: str) -> int:
        if t not in depth:
            ring = {p for p in above[t] if t in above[p]} | {t}
            outside = above[t] - ring
            for x in ring:
                depth[x] = -1
            level = max((layer(p) + 1 for p in outside), default=0)
            for x in ring:
                depth[x] = level
        return depth[t]

    out: list[list[str]] = [[] for _ in range(max(map(layer, above), default=-1) + 1)]
    for t in sorted(above):
        out[depth[t]].append(t)
    return out
