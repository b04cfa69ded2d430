"""Small functions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import dates, expressions, hashing, strings


def _murmur(key, seed=0):
    """MurmurHash3 for x86, 128 bits, block by block."""
    most, c = 0xFFFFFFFF, [0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93]
    turn = lambda x, n: (x << n | x >> (32 - n)) & most
    h, whole = [seed] * 4, len(key) // 16 * 16
    mix = lambda k, j: turn(k * c[j] & most, 15 + j) * c[(j + 1) % 4] & most
    for at in range(0, whole, 16):
        for j in range(4):
            h[j] ^= mix(int.from_bytes(key[at + 4 * j : at + 4 * j + 4], "little"), j)
            h[j] = ((turn(h[j], 19 - 2 * j) + h[(j + 1) % 4]) * 5 + [0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17][j]) & most
    for j in range(4):
        h[j] ^= mix(int.from_bytes(key[whole + 4 * j : whole + 4 * j + 4], "little"), j) ^ len(key)

    def add():
        h[0] = sum(h) & most
        h[1:] = [(x + h[0]) & most for x in h[1:]]

    add()
    for j in range(4):
        h[j] = (h[j] ^ h[j] >> 16) * 0x85EBCA6B & most
        h[j] = (h[j] ^ h[j] >> 13) * 0xC2B2AE35 & most
        h[j] ^= h[j] >> 16
    add()
    return h


def test_x86_hashes(spark):
    rng = random.Random(1)
    keys = [b"", b"The quick brown fox jumps over the lazy dog", *(rng.randbytes(n) for n in range(70))]
    for seed in (0, 123):
        assert hashing.murmur3_x86_128_many(keys, seed).tolist() == [_murmur(k, seed) for k in keys]
    assert [f"{x:08x}" for x in _murmur(keys[1])] == ["2f1583c3", "ecee2c67", "5d7bf66c", "e5e91d2c"]  # a published value
    df = spark.createDataFrame([("",), ("ä b",), (None,)], "s string").select(hashing.murmur128_x86()(F.col("s")).alias("h")).collect()
    assert [r.h for r in df] == ["0" * 32, "".join(f"{x:08x}" for x in reversed(_murmur("ä b".encode()))), None]


def test_texts(spark):
    df = spark.createDataFrame([("a\nb",), ("a\nx\n",), ("",), (None,), ("xx",)], "t string")
    assert [r[0] for r in df.select(strings.line_added(F.col("t"), "x")).collect()] == ["a\nb\nx\n", "a\nx\n", "x\n", "x\n", "xx\nx\n"]
    packed = df.select("t", strings.gzipped()(F.col("t")).alias("z"))
    assert [r[0] for r in packed.select(strings.gunzipped()(F.col("z"))).collect()] == [r.t for r in df.collect()]
    drawn = spark.range(500).select(strings.random_text(8, F.col("id"), characters="abc").alias("r"))
    assert drawn.filter("r rlike '^[abc]{8}$'").distinct().count() > 450 and drawn.collect() == drawn.collect()
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None), (1, 2, "a")], "k int, o int, t string")
    assert sorted(map(tuple, strings.concatenated(parts, "k", "o", "t").collect())) == [(1, "aab"), (2, "")]


def test_kept_times(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 12:00:00.123456' AS t").select(dates.utc_micros(F.col("t"), "Europe/London").alias("k"), "t")
    row = df.select("k", dates.from_utc_micros(F.col("k"), "Europe/London").alias("back"), "t").first()
    assert row.k.hour == 11 and row.k.microsecond == 123456 and row.back == row.t


def test_expressions(spark):
    quoted = spark.createDataFrame([("ab'c\"d",), ("a\\b\n\t\x1f",), (None,)], "s string").select(expressions.double_quoted(F.col("s")).alias("q")).collect()
    assert [r.q for r in quoted] == ['"ab\'c\\"d"', '"a\\\\b\\n\\t\\x1F"', None]
    for identifier, term in ((12345, "short"), (123456, "a|b"), (10**18, "long")):
        with pytest.raises(Exception, match="not a concept|a bar"):
            spark.range(1).select(expressions.concept_reference(F.lit(identifier), F.lit(term))).collect()
    focus = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "id int, place int, concept string")
    rows = spark.createDataFrame([(1, 2, 1, "g", "2"), (1, None, 2, "y", "w"), (1, None, 1, "x", "v"), (1, 1, 1, "e", "1"), (1, 1, 2, "f", None)], "id int, group int, place int, name string, value string")
    found = {r.id: r.expression for r in expressions.expressions(focus, rows).collect()}
    assert found == {1: "a + b : x = v, y = w, { e = 1 }, { g = 2 }", 2: "c"}
