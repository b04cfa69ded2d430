"""Table functions, and encodings found by their bytes."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import tables
from strandline.sources import encodings


def test_table_functions(spark):
    tables.register(spark)
    rows = "VALUES ('a', 1, 3), ('a', 2, 5), ('a', 5, 6), ('a', 8, 9), ('a', NULL, 4), ('a', 9, 7), ('b', 1, 1), (NULL, 1, 2)"
    found = spark.sql(f"SELECT * FROM merged_intervals(TABLE(SELECT * FROM {rows} t(k, b, e)) PARTITION BY k ORDER BY b)")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, 6, 3), ("a", 8, 9, 1), ("b", 1, 1, 1), (None, 1, 2, 1)], key=str)
    days = spark.sql("SELECT * FROM interval_days(TIMESTAMP_NTZ'2024-01-05 22:00:00', TIMESTAMP_NTZ'2024-01-07 06:00:00')").collect()
    assert [(d.day.day, d.hours, d.weekday) for d in days] == [(5, 2.0, 5), (6, 24.0, 6), (7, 6.0, 7)]
    assert spark.sql("SELECT * FROM interval_days(TIMESTAMP_NTZ'2024-01-05 22:00:00', NULL)").collect() == []
    block = spark.sql("SELECT * FROM csv_block(concat_ws(chr(10), 'x', 'a,b', '1,\"2,3\"', 'only', '', '9,9'), 'a,b')").collect()
    assert [(r.line, r.name, r.value) for r in block] == [(2, "a", "1"), (2, "b", "2,3"), (3, "a", "only")]
    with pytest.raises(Exception, match="three columns"):
        spark.sql("SELECT * FROM merged_intervals(TABLE(SELECT 1 AS x))").collect()
    assert spark.sql("SELECT logit(0D) AS a, logit(0.5D) AS b, blank_to_null(' ') AS c").first()[:] == (None, 0.0, None)


def test_encodings(spark):
    bits = encodings.pair_bits(F.col("text"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    text = "Der Bär hört für größere Völker. L'été à Orléans. El niño está aquí."
    for name in ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "cp850", "mac-roman"):
        assert text.encode(name).decode(encodings.detect(text.encode(name), bits)) == text, name
    for name in ("utf-8-sig", "utf-16", "utf-32"):
        assert text.encode(name).decode(encodings.detect(text.encode(name), bits)) == text, name
    assert [encodings.detect(x, bits) for x in (None, b"", b"plain", "é".encode())] == [None, None, "ascii", "utf-8"]
    assert encodings.detect(b"\x81\x8d\x8f\x90\x9d", bits) != "cp1252"  # which has no such bytes
    assert encodings.detect(b"\xff\xfe\xfd", bits, ()) == "utf-16" and encodings.detect(b"a\xff", bits, ()) == "latin-1"
    russian = "Съешь же ещё этих мягких французских булок, да выпей чаю"
    known = encodings.pair_bits(F.col("t"), spark.createDataFrame([(russian,), (text,), (None,)], "t string"))
    assert all(russian.encode(x).decode(encodings.detect(russian.encode(x), known)) == russian for x in ("cp1251", "koi8-r"))
    assert encodings.pair_bits(F.col("t"), spark.createDataFrame([("plain",)], "t string")) == {"": 1.0}
    df = spark.createDataFrame([(bytearray(text.encode("cp850")),), (None,), (bytearray(b""),)], "raw binary")
    assert [tuple(r) for r in df.select(encodings.encodings(F.col("raw"), bits), encodings.texts(F.col("raw"), bits)).collect()] == [("cp850", text), (None, None), (None, "")]


def test_encodings_of_shouted_words(spark):
    bits = encodings.pair_bits(F.col("text"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    shouted = "ENÄ!! ENBEÄ!! Ä!! SCHERBEÄ!! ENAUÜ!! " * 25 + "ééelle onçou, laouêtionier"  # repeated: once as evidence
    for name in ("cp1252", "cp850", "mac-roman"):
        assert shouted.encode(name).decode(encodings.detect(shouted.encode(name), bits)) == shouted, name
    lacking = "Œuvre à Łódź, für größere Völker → élan"  # which cp850 can't write
    df = spark.createDataFrame([(lacking, "cp850"), (lacking, "utf-16-le"), (None, "cp850")], "t string, e string")
    back = df.select(encodings.texts(encodings.encoded(F.col("t"), F.col("e")), bits).alias("x")).collect()
    assert [r.x for r in back] == [lacking, lacking, None]
