"""Removal of repeated lines or paragraphs across documents.

Units are normalised (lower case, runs of white space as one space) and hashed by Spark's own functions; digests are grouped
over all documents with map-side sums, the earliest occurrence by rank stays, and the others are cut from their documents.
Only digests and unit numbers are shuffled until each document meets the list of its removed units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import join_hot, stored

#: Units of fewer words stay wherever they are: only blank ones.
LEAST_WORDS = 1
#: Alike for Python and Java.
DIVIDERS = {"line": r"\n", "paragraph": r"\n[ \t\r\f]*\n[ \t\r\f\n]*"}


def units(text: str, divider: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of each unit, in characters."""
    at = 0
    for m in divider.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def hashed(named: DataFrame, pattern: str, least_words: int) -> DataFrame:
    """Rows (rank, _id, _h, unit, digest) of the units of ``_text`` that have words enough."""
    each = named.select("rank", "_id", "_h", F.posexplode(F.split("_text", pattern, -1)).alias("unit", "_unit"))
    words = F.trim(F.regexp_replace(F.lower("_unit"), r"\s+", " "))
    each = each.select("rank", "_id", "_h", "unit", words.alias("_words")).filter("_words <> ''")
    if least_words > 1:
        each = each.filter(F.size(F.split("_words", " ")) >= least_words)
    return each.select("rank", "_id", "_h", "unit", F.unhex(F.md5("_words")).alias("digest"))


def _cut(pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divider = re.compile(pattern)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_units", "kept_text", "kept", "removed")}
            for text, gone in zip(batch.column("_text").to_pylist(), batch.column("gone").to_pylist()):
                gone, n, kept, removed, pieces, last = set(gone or ()), 0, [], [], [], 0
                for k, (a, b) in enumerate(units(text, divider) if text is not None else ()):
                    n += 1
                    if k in gone:
                        removed.append({"unit": k, "start": a, "end": b})
                    else:
                        pieces.append(text[last if kept else a : b])  # with the divider before it
                        kept.append({"unit": k, "start": a, "end": b})
                    last = b
                out["n_units"].append(n)
                out["kept_text"].append(None if text is None else "".join(pieces))
                out["kept"].append(kept)
                out["removed"].append(removed)
            spans = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out["n_units"], pa.int32()), pa.array(out["kept_text"], pa.string()), pa.array(out["kept"], spans), pa.array(out["removed"], spans)], names=["row", *out])

    return work


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rank: str | None = None, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """Each row of ``docs`` without the units that an earlier ranked document (or it itself, further up) has too.

    Returns the other columns of ``docs`` in the struct ``row`` plus n_units, kept_text, kept and removed (arrays of unit
    number, start and end in characters of the original). rank: a column, low first (default: the id; null last); ties go
    by id, then text. Equal rows stand for one occurrence and come out alike. A null text has no units; an empty one has
    one, of no words, which stays. Kept units keep one divider between them. An empty table gives an empty table.
    """
    pattern = DIVIDERS[unit]
    key = [F.coalesce(F.col(rank or doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("rank"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(doc_id, text).alias("_h")]
    found = stored(hashed(docs.select(*key, F.col(text).alias("_text")).filter("_text is not null"), pattern, least_words), "units")
    first = F.min(F.struct("rank", "_id", "_h", "unit")).alias("first")
    several = stored(found.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    later = join_hot(found, several, "digest", ["_id", "_h", "unit"], "n").filter(F.struct("rank", "_id", "_h", "unit") != F.col("first"))
    gone = later.groupBy("_id", "_h").agg(F.collect_set("unit").alias("gone")).withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    named = docs.select(*key[1:], F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    joined = named.join(gone, (F.col("_id") == F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left").select("row", "_text", "gone")
    spans = "array<struct<unit:int,start:int,end:int>>"
    return joined.mapInArrow(_cut(pattern), f"row {joined.schema['row'].dataType.simpleString()}, n_units int, kept_text string, kept {spans}, removed {spans}")
