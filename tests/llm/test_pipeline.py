"""The pipeline's stages, each against brute force on its own input, and the entry with and without it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

from test_dedup import removed_by_hand, stage_groups
from test_texts import packed_right

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strandline.llm import common, langid, mixing, packing

SF = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "best_fit_packing" or docs.columns == columns
    read = lambda name: spark.read.parquet(str(tmp_path / name)).collect()
    names = [n for n, _ in corpus_pipeline.STAGES]

    rejected = {r.doc_id for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).filter("rejected").collect()}
    assert {r.doc_id for r in read(names[0])} == {r.doc_id for r in inputs[names[0]]} - rejected

    rows = sorted(inputs[names[1]], key=lambda r: r.doc_id)
    first = stage_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in read(names[1])) == [rows[i].doc_id for i in sorted(set(first))]

    rows = [(r.doc_id, r.text) for r in inputs[names[2]]]
    cut = {r[0]: r for r in removed_by_hand(rows, corpus_pipeline.PASSAGE)}
    for r in read(names[2]):
        n, gone = cut[r.doc_id][1:3]
        assert n - gone - 6 * cut[r.doc_id][3] <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)

    left = read(names[2])
    chosen = mixing.mix(mixing.described(spark.read.parquet(str(tmp_path / names[2]))), mixing.LEVELS, mixing.WEIGHTS).collect()
    assert sorted(r.doc_id for r in read(names[3])) == sorted(r.doc_id for r in chosen) and sum(r.taken for r in chosen) <= sum(len(r.text.split()) for r in left)
    assert sum(len(ASCII_WORD.findall(r.text)) for r in read(names[3])) == sum(r.taken for r in chosen)

    packed_right([(r.doc_id, r.text) for r in inputs[names[4]]], read(names[4]))
    key = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(read(names[4]))


def test_stages_send_small_batches_to_python(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.unset(common.BATCH_LIMIT)
    try:
        corpus_pipeline.pack_sequences(spark, docs, SF)
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 4000 and max(r.size for r in found) < 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_LIMIT, "64m")  # the session's own
        corpus_pipeline.pack_sequences(spark, docs, SF)
        assert spark.conf.get(common.BATCH_LIMIT) == "64m"
    finally:
        spark.conf.unset(common.BATCH_LIMIT)


def test_no_words_stay_in_a_worker_after_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")

    def work(batches):
        pieces = sum(x.num_rows for x in packing._pieces(path, 64)(batches))
        words = packing.word_ids(path)
        yield pa.RecordBatch.from_arrays([pa.array([pieces]), pa.array([len(words) + len(words.before)])], names=["pieces", "words"])

    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("_text"))
    assert [tuple(r) for r in docs.mapInArrow(work, "pieces long, words long").collect()] == [(300, 0)]


def test_entry_without_this_subpackage(tmp_path):
    assert {"pipeline", "op10_language_id"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
