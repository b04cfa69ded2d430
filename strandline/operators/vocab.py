"""Vocabularies: concept filters, walks over relationships, categories by nearest ancestor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.storage import ended, forget

CONCEPT = T.StructType(
    [
        T.StructField("concept_id", T.IntegerType()),
        *(T.StructField(c, T.StringType()) for c in ("concept_name", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code")),
        T.StructField("valid_start_date", T.StringType()),
        T.StructField("valid_end_date", T.StringType()),
        T.StructField("invalid_reason", T.StringType()),
    ]
)
RELATIONSHIP = T.StructType(
    [
        T.StructField("concept_id_1", T.IntegerType()),
        T.StructField("concept_id_2", T.IntegerType()),
        T.StructField("relationship_id", T.StringType()),
        T.StructField("valid_start_date", T.StringType()),
        T.StructField("valid_end_date", T.StringType()),
        T.StructField("invalid_reason", T.StringType()),
    ]
)
IS_A, MAPS_TO, MAPPED_FROM, SUBSUMES = "Is a", "Maps to", "Mapped from", "Subsumes"


def read_vocabulary(spark, path: str, schema: T.StructType) -> DataFrame:
    """A tab-separated vocabulary file with its header; dates are written yyyyMMdd."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=False)
    return df.withColumns({c: F.to_date(c, "yyyyMMdd") for c in ("valid_start_date", "valid_end_date")})


def filtered(df: DataFrame, keep: dict[str, Sequence] | None = None, drop: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows whose columns hold one of the values to keep and none of those to drop; an empty list doesn't filter."""
    for column, values in (keep or {}).items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    for column, values in (drop or {}).items():
        if values:
            df = df.filter(~F.col(column).isin(list(values)))
    return df


def semi_anti(df: DataFrame, on: str, keep: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """The same with tables of values (first column) for lists too long to write down."""
    for table, how in ((keep, "left_semi"), (drop, "left_anti")):
        if table is not None:
            values = table.select(F.col(table.columns[0]).alias("_v")).filter("_v is not null").distinct()
            df = df.join(values, F.col(on) == F.col("_v"), how)
    return df


def ancestors(edges: DataFrame, starts: DataFrame, relationships: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows (start, ancestor, generation) over edges (child, parent, relationship), each ancestor at its least generation;
    ``most``, where given, bounds the generations. A ring doesn't make a node its own ancestor.

    Paths double: what lies n generations up, followed by all that is known above it, gives what lies up to 2 n up, so a chain
    of a thousand takes ten joins. The walk ends when nothing lies exactly as far up as was looked. Rings end likewise.
    """
    own = edges if relationships is None else edges.filter(F.col("relationship").isin(list(relationships)))
    first = own.filter("child <> parent").select(F.col("child").alias("start"), F.col("parent").alias("ancestor"), F.lit(1).alias("generation")).distinct()
    pairs, reach = ended(first, "ancestors"), 1
    while (most is None or reach < most) and (pairs.agg(F.max("generation")).first()[0] or 0) == reach:
        front = pairs.filter(F.col("generation") == reach).select("start", F.col("ancestor").alias("node"))
        above = pairs.select(F.col("start").alias("node"), "ancestor", (F.col("generation") + reach).alias("generation"))
        step = front.join(above, "node").filter("start <> ancestor").select("start", "ancestor", "generation")
        before, pairs = pairs, ended(pairs.union(step).groupBy("start", "ancestor").agg(F.min("generation").alias("generation")), "ancestors")
        forget(before)
        reach *= 2
    at = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    found = pairs.join(at, "start", "left_semi")
    return found if most is None else found.filter(F.col("generation") <= most)


def dependencies_in_layers(edges: DataFrame) -> DataFrame:
    """Rows (name, layer) over edges (child, parent) without rings: one more than the largest layer of what a name depends on, 0
    for names without a parent. Longest paths double as ``ancestors``' shortest do; a ring is an error."""
    own = edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent", F.lit(1).alias("steps")).distinct()
    pairs, reach = ended(own, "layers"), 1
    while (pairs.agg(F.max("steps")).first()[0] or 0) >= reach:
        if not pairs.filter("child = parent").isEmpty():
            raise ValueError("names depend on each other in a ring")
        above = pairs.select(F.col("child").alias("parent"), F.col("parent").alias("_up"), F.col("steps").alias("_more"))
        step = pairs.join(above, "parent").select("child", F.col("_up").alias("parent"), (F.col("steps") + F.col("_more")).alias("steps"))
        before, pairs = pairs, ended(pairs.union(step).groupBy("child", "parent").agg(F.max("steps").alias("steps")), "layers")
        forget(before)
        reach *= 2
    named = pairs.select(F.col("child").alias("name"), "steps").union(pairs.select("parent", F.lit(0)))
    return named.groupBy("name").agg(F.max("steps").alias("layer"))


def category(entities: DataFrame, edges: DataFrame, categories: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Rows (entity, category): set by hand (entity, category), else itself or an ancestor, the first by ordinal.

    ``categories`` has category and ordinal, names in any case; entities without one come out null.
    """
    who = entities.select(F.col(entities.columns[0]).alias("entity")).distinct()
    up = ancestors(edges, who).select(F.col("start").alias("entity"), "ancestor").union(who.select("entity", F.col("entity").alias("ancestor")))
    named = categories.select(F.lower("category").alias("_k"), "category", "ordinal")
    best = up.join(named, F.lower("ancestor") == F.col("_k")).groupBy("entity").agg(F.min_by("category", "ordinal").alias("_found"))
    out = who.join(best, "entity", "left")
    if manual is None:
        return out.select("entity", F.col("_found").alias("category"))
    by_hand = manual.groupBy(F.lower("entity").alias("_m")).agg(F.min("category").alias("_hand"))
    return out.join(by_hand, F.lower("entity") == F.col("_m"), "left").select("entity", F.coalesce("_hand", "_found").alias("category"))


def equivalents(concepts: DataFrame, relationships: DataFrame, source_vocabulary: str, codes: Sequence[str], target_vocabulary: str, descendants: bool = False, hops: Sequence[str] = (MAPS_TO, MAPPED_FROM, SUBSUMES)) -> DataFrame:
    """Concepts of one vocabulary that codes of another lead to: rows (source_code, target_code, target_name)."""
    source = concepts.filter((F.col("vocabulary_id") == source_vocabulary) & F.col("concept_code").isin(list(codes))).select(F.col("concept_code").alias("source_code"), F.col("concept_id").alias("node"))
    if descendants:
        down = relationships.filter(F.col("relationship_id") == IS_A).select(F.col("concept_id_2").alias("child"), F.col("concept_id_1").alias("parent"), F.col("relationship_id").alias("relationship"))
        below = ancestors(down, source.select("node")).select(F.col("start").alias("node"), "ancestor")
        source = source.union(source.join(below, "node").select("source_code", F.col("ancestor").alias("node"))).distinct()
    hop = relationships.filter(F.col("relationship_id").isin(list(hops))).select(F.col("concept_id_1").alias("node"), F.col("concept_id_2").alias("target"))
    target = concepts.filter(F.col("vocabulary_id") == target_vocabulary).select(F.col("concept_id").alias("target"), F.col("concept_code").alias("target_code"), F.col("concept_name").alias("target_name"))
    return source.join(hop, "node").join(target, "target").select("source_code", "target_code", "target_name").distinct()
