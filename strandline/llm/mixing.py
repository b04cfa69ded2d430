"""Mixing documents to target weights on a tree such as domain, language, source.

A node's budget is split among its children in proportion to their weights, none getting more than its leaves hold in
``epochs`` passes; what one child can't use goes to its siblings. As a child's capacity is that of its whole subtree, a
shortage is made up among the nearest siblings first and reaches an ancestor's siblings only when those are full. Each
leaf then takes whole passes over its documents and, of one more pass in that pass's seeded order, a prefix of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import ascii_words, forget, parts, row_keys, stored

SEED = 7
EPOCHS = 2
#: Rows that share one copy of their leaf's allocation, about: a hot leaf is met by as many copies as its rows need.
SALT_ROWS = 250_000
#: Leading hex digits of a document's place in its pass; sums by these make prefix sums without sorting a leaf in one task.
_DIGITS = 3


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _split(children: DataFrame, parents: list[str]) -> DataFrame:
    """``children`` (with parent's budget, w, cap) with alloc: proportional to w, at most cap, by filling the smallest cap/w first."""
    within = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = within.orderBy(F.try_divide("cap", "w"), *[F.col(c) for c in children.columns if c not in ("budget", "w", "cap")])
    filled = children.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    full = F.col("cap").cast("decimal(38,0)") * F.col("rest") <= F.col("w").cast("decimal(38,0)") * (F.col("budget") - F.col("before"))
    filled = filled.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(within), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(within)
    filled = filled.withColumns({"left": left, "open": open_})
    part = F.expr("cast(cast(w as decimal(20,0)) * cast(left as decimal(18,0)) div open as bigint)")
    return filled.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("before", "rest", "full", "left", "open", "w", "budget", "cap")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, epochs: int = EPOCHS) -> DataFrame:
    """``leaves`` (levels, tokens: one row a leaf) with alloc, the tokens that each is to give.

    A weight of 0 leaves a node out: it can take nothing, and its share goes to its siblings. Negative weights are an error.
    """
    if any(w < 0 for own in weights.values() for w in own.values()):
        raise ValueError("a weight is negative")
    out = F.lit(False)
    for level in levels:
        out = out | (_weight(level, weights) == 0)
    leaves = leaves.withColumn("cap", F.when(out, F.lit(0).cast("long")).otherwise(F.col("tokens") * epochs))
    known = None
    for depth in range(1, len(levels) + 1):
        parents, own = levels[: depth - 1], levels[:depth]
        children = leaves.groupBy(*own).agg(F.sum("cap").cast("long").alias("cap")).withColumn("w", _weight(own[-1], weights))
        if known is None:
            children = children.withColumn("budget", F.lit(budget).cast("long"))
        else:
            children = children.join(known.withColumnRenamed("alloc", "budget"), parents)
        known = _split(children, parents)
    return leaves.drop("cap").join(known, levels)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows (levels, doc_id, h, tokens, epoch, taken): the documents chosen, once for each pass that takes them.

    ``docs`` has the columns of ``levels`` (strings; null counts as empty), doc_id, h (tells rows of equal id apart) and
    tokens (null: 0). budget: tokens in all (default: as many as there are). taken is the number of the document's tokens
    inside the prefix, less than tokens only for the last one of a leaf. Documents without tokens are taken in whole
    passes only. Equal rows are each chosen by the same rule. An empty table gives an empty table.
    """
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels], "doc_id", "h", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    base = stored(base, "tokens")
    leaves = stored(base.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    if budget is None:
        budget = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, levels, weights, budget, epochs)
    given = given.select(*levels, F.expr("case when tokens > 0 then alloc div tokens else 0 end").alias("passes"), F.expr("case when tokens > 0 then alloc % tokens else 0 end").alias("more"))
    salts = parts(base.count(), SALT_ROWS)
    given = stored(given, "budgets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    met = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts)).cast("int")).join(given, [*levels, "salt"])
    met = stored(met.select(*levels, "doc_id", "h", "tokens", "passes", "more", place.alias("place")), "places")
    forget(base, leaves)
    met = met.withColumn("bucket", F.substring("place", 1, _DIGITS))
    columns = [*levels, "doc_id", "h", "tokens", "epoch", "taken"]
    whole = met.filter("passes > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(passes as int) - 1)"))).withColumn("taken", F.col("tokens"))
    sums = met.filter("more > 0").groupBy(*levels, "bucket").agg(F.sum("tokens").alias("size"))
    ahead = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    part = met.filter("more > 0 and tokens > 0").join(sums, [*levels, "bucket"]).withColumn("epoch", F.col("passes").cast("int"))
    inside = part.filter("before + size <= more").withColumn("taken", F.col("tokens"))
    own = Window.partitionBy(*levels, "bucket").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.filter("before < more and before + size > more").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    edge = edge.filter("at < more").withColumn("taken", F.least(F.col("tokens"), F.col("more") - F.col("at")))
    return whole.select(*columns).union(inside.select(*columns)).union(edge.select(*columns))


#: The tree of ``documents``: a domain is made up from the source's last character.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 1, "d1": 2, "d2": 3, "d3": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def _levels(lang: Column, source: Column) -> list[Column]:
    """The columns of ``LEVELS``."""
    domain = F.concat(F.lit("d"), (F.ascii(F.substring(F.coalesce(source, F.lit("")), -1, 1)) % 4).cast("string"))
    return [domain, lang, source]


def described(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Rows (domain, lang, source, doc_id, h, tokens) of a table like ``documents``; tokens are words."""
    levels = zip(LEVELS, _levels(F.col(lang), F.col(source)))
    return docs.select(*[c.alias(level) for level, c in levels], F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(ascii_words(text), F.lit(0)).alias("tokens"))


def _prefix(text: Column, words: Column) -> Column:
    """The first words of a text with what stands before and between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words), "")


def remixed(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` in the mix of ``WEIGHTS``: each row once for each pass that takes it, with as many tokens as there were in all.

    The last row of a leaf's last pass has only those of its words that the budget holds (and n_chars, where there is one,
    counted again). Equal rows share equally what the last pass takes of them.
    """
    own = [*LEVELS, "doc_id", "h"]
    rows = described(docs)
    named = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS], "doc_id", "h")
    chosen = stored(mix(rows, LEVELS, WEIGHTS, epochs=epochs), "mixed")
    each = chosen.groupBy(*own, "epoch").agg(F.sum("taken").alias("taken"), F.max("tokens").alias("tokens"))
    copies = named.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if copies.limit(1).count():
        copies = copies.withColumnsRenamed({c: f"{c}2" for c in own})
        same = F.lit(True)
        for c in own:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
        each = each.join(copies, same, "left").withColumn("taken", F.expr("taken div coalesce(copies, 1)")).filter("taken > 0 or tokens = 0")
    part = F.when(F.col("taken") < F.col("tokens"), F.col("taken").cast("int"))
    each = stored(each.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *[F.col(c).alias(f"_{c}") for c in LEVELS], part.alias("_part")), "chosen")
    forget(chosen)
    each, meant = row_keys(each, docs, "doc_id", "text")
    *levels, part = (each[c] for c in each.columns[2:])
    for level, c in zip(levels, _levels(docs["`lang`"], docs["`source`"])):
        meant = meant & (F.coalesce(c, F.lit("")) == level)
    text = F.when(part.isNotNull(), _prefix(docs["`text`"], part)).otherwise(docs["`text`"])
    met = docs.join(each, meant)
    out = {"text": text.alias("text"), "n_chars": F.when(part.isNotNull(), F.length(text).cast("long")).otherwise(docs["`n_chars`"]).alias("n_chars") if "n_chars" in docs.columns else None}
    return met.select(*[out[c] if c in out else docs[f"`{c}`"] for c in docs.columns])
