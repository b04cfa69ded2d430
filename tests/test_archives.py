"""Zips written and read by many tasks; documents in them."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from strandline.sources import archives, documents


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_members_are_shared_out(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    _zip(tmp_path / "a.zip", {f"m{k}.txt": os.urandom(1000) for k in range(40)} | {"dir/": b""})
    _zip(tmp_path / "deep" / "b.zip", {"x.html": b"<p>x", "empty.txt": b""})
    _zip(tmp_path / "c.notzip", {"no.txt": b"no"})
    for size, least in ((64_000_000, 1), (5_000, 8)):
        monkeypatch.setattr(archives, "PARTITION_BYTES", size)
        reader = archives._Reader(spark.createDataFrame([], "member string").schema, {"path": str(tmp_path)})
        parts = reader.partitions()
        assert len(parts) >= least
        names = [b.column("member")[0].as_py() for p in parts for b in reader.read(p)]
        assert sorted(names) == sorted([*(f"m{k}.txt" for k in range(40)), "x.html", "empty.txt"])
    found = archives.members(spark, str(tmp_path), "*.txt", ("member", "size"))
    assert found.columns == ["member", "size"] and found.agg(F.count("*"), F.sum("size")).first()[:] == (41, 40_000)
    assert archives.members(spark, f"file:{tmp_path}/deep").filter("member = 'empty.txt'").first().content == b""
    assert archives.members(spark, str(tmp_path / "deep" / "b.zip")).count() == 2
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("zip_members").schema("other string").load(str(tmp_path)).collect()


def test_only_columns_asked_for_are_read(tmp_path):
    """Contents are damaged: names and sizes still come, contents don't."""
    path = tmp_path / "a.zip"
    _zip(path, {"m.txt": b"hello " * 100})
    raw = bytearray(path.read_bytes())
    raw[60] ^= 255
    path.write_bytes(raw)
    from pyspark.sql.types import StructType

    kind = lambda text: StructType.fromDDL(text)
    names = archives._Reader(kind("member string, size bigint"), {"path": str(tmp_path)})
    assert [b.to_pylist() for b in names.read(names.partitions()[0])] == [[{"member": "m.txt", "size": 600}]]
    whole = archives._Reader(kind("content binary"), {"path": str(tmp_path)})
    with pytest.raises(zipfile.BadZipFile):
        list(whole.read(whole.partitions()[0]))


def test_round_trip(spark, tmp_path):
    rows = [(f"f{k}.txt", f"tèxt {k}" * k) for k in range(30)] + [("null.txt", None)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(3)
    assert archives.write_zips(df, str(tmp_path / "out"), "name", "body") == 31
    back = {r.member: r.content.decode() for r in archives.members(spark, str(tmp_path / "out")).collect()}
    assert back == {n: b or "" for n, b in rows} and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".begun")]
    assert archives.write_zips(df.limit(0), str(tmp_path / "none"), "name", "body") == 0
    assert archives.members(spark, str(tmp_path / "none")).collect() == []


def test_documents_in_zips(spark, tmp_path):
    kinds = ["txt", "html", "xml", "eml", "docx", "odt"]
    rows = spark.createDataFrame([(k, "a <b> & ç\nline two") for k in kinds], "kind string, text string")
    files = rows.select(F.concat(F.lit("d."), "kind").alias("name"), documents.written(F.col("text"), F.col("kind")).alias("content"))
    broken = spark.createDataFrame([("bad.docx", bytearray(b"no zip"))], "name string, content binary")
    archives.write_zips(files.union(broken), str(tmp_path), "name", "content")
    found = {r.member: r for r in archives.member_texts(archives.members(spark, str(tmp_path))).collect()}
    assert found["bad.docx"].text is None and "BadZipFile" in found["bad.docx"].error
    for k in kinds:
        assert found[f"d.{k}"].text.split() == "a <b> & ç line two".split(), k
