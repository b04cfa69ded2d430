"""Clinical expressions of concepts, as text: references, quoted values, attribute sets and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many digits a concept's number has.
LEAST_DIGITS, MOST_DIGITS = 6, 18


def double_quoted(text: Column) -> Column:
    """Text in double quotes; quotes, backslashes, line feeds and tabs are escaped, other control characters as two hex digits."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    for code in range(32):
        if chr(code) not in "\n\t":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02X}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def concept_reference(identifier: Column, term: Column | None = None) -> Column:
    """``identifier |term|``, or the identifier alone; an error if it has another number of digits or the term a bar."""
    digits = identifier.cast("string")
    wrong = ~F.length(digits).between(LEAST_DIGITS, MOST_DIGITS)
    out = F.when(wrong, F.raise_error(F.concat(F.lit("not a concept: "), digits)).cast("string"))
    if term is None:
        return out.otherwise(digits)
    return out.when(F.contains(term, F.lit("|")), F.raise_error(F.concat(F.lit("a bar in a term: "), term)).cast("string")).otherwise(F.concat(digits, F.lit(" |"), term, F.lit("|")))


def value_text(concept: Column | None = None, number: Column | None = None, text: Column | None = None, expression: Column | None = None) -> Column:
    """An attribute's value, the first of these that isn't null: a reference to a concept, a number, a text, an expression."""
    forms = [
        concept, None if number is None else F.concat(F.lit("#"), number.cast("string")), None if text is None else double_quoted(text),
        None if expression is None else F.concat(F.lit("( "), expression, F.lit(" )")),
    ]
    return F.coalesce(*[f for f in forms if f is not None])


def expressions(focus: DataFrame, attributes: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, expression): what an expression says, by its focus concepts (key, place, concept) and attributes (key, group,
    place, name, value), all as text already.

    Concepts are joined by plus signs. Attributes without a group come first, then each group in braces, by number; within these
    by place. An expression without attributes is its concepts. Nulls are left out.
    """
    heads = focus.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda x: x["concept"]), " + ").alias("_focus"))
    pair = F.concat(F.col("name"), F.lit(" = "), F.col("value"))
    sets = attributes.groupBy(key, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", pair.alias("pair")))), lambda x: x["pair"]), ", ").alias("_set"))
    braced = sets.withColumn("_set", F.when(F.col("group").isNull(), F.col("_set")).otherwise(F.concat(F.lit("{ "), F.col("_set"), F.lit(" }"))))
    order = F.struct(F.col("group").isNotNull().alias("grouped"), F.col("group").alias("group"), F.col("_set").alias("text"))
    joined = braced.filter("_set <> ''").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), ", ").alias("_refined"))
    met = heads.join(joined, key, "left")
    return met.select(key, F.when(F.col("_refined").isNull(), F.col("_focus")).otherwise(F.concat(F.col("_focus"), F.lit(" : "), F.col("_refined"))).alias("expression"))
