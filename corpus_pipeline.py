"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing and packing, one stage after another.

Each stage takes (spark, docs, sf_dir) and the rows that its predecessor kept; all but the last return the columns of
``documents``. ``sf_dir`` is there for stages that read other tables; none of these does. Stages with work in Python have rows sent
there in small batches, for as long as the session lasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import forget, small_batches, stored
from strandline.llm.langid import accepted
from strandline.llm.mixing import remixed
from strandline.llm.packing import pack
from strandline.llm.simhash import one_of_each
from strandline.llm.suffix_dedup import without_repeats


#: Bytes of a passage that goes if it stands in several places: about 40 words, so that one of 50 words is whole inside.
PASSAGE = 240


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models are trained on this stage's own input."""
    small_batches(spark)
    return accepted(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE`` bytes that stand in several places."""
    small_batches(spark)
    return without_repeats(docs, length=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix: a row for each pass that takes one, and none where no budget is left for it.

    Repeats that the stages before have removed come back here on purpose: a source with too little text for its budget is passed
    over up to ``mixing.EPOCHS`` times, so a document, and every line of it, may stand in that many rows.
    """
    return remixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Suffix arrays, hashing and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them, and then those before go."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
