"""Documented examples and edge cases of the operators."""

import datetime as dt
import email.message
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import convert, dates, dsp, hashing, rounding, rpm, strings
from strandline.operators import columns, intervals, lookup, sqlops, vocab
from strandline.operators.episodes import two_drug_episodes
from strandline.operators.timeline import cumulative_time
from strandline.sources import delimited, documents
from strandline.streaming import timelines as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(*x):
    return dt.datetime(*x)


def test_cumulative_time(spark):
    events = [("Alice", d) for d in ("2018-01-05", "2018-01-20", "2018-04-01")] + [("Bob", d) for d in ("2018-06-05", "2018-08-20", "2018-10-01")]
    asked = [
        ("Alice", "2017-01-01", "2018-01-01", 365, 0, 0),
        ("Alice", "2017-01-01", "2018-01-10", 369, 3, 2),
        ("Alice", "2017-01-01", "2018-02-01", 369, 6, 21),
        ("Bob", "2015-01-01", "2018-01-01", 1096, 0, 0),
        ("Bob", "2015-01-01", "2018-09-10", 1251, 6, 91),
        ("Bob", "2015-01-01", "2019-02-01", 1251, 9, 232),
        ("Nobody", "2018-01-01", "2018-01-03", 2, 0, 0),
        ("Bob", "2019-01-01", "2018-01-03", 0, 0, 0),
    ]
    cast = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    e = spark.createDataFrame(events, "p string, t string").select("p", cast("t"))
    q = spark.createDataFrame([r[:3] for r in asked], "p string, start string, when string").select("p", cast("start"), cast("when"))
    got = cumulative_time(e, q, "p", "t", F.expr("interval 3 days")).collect()
    want = {(r[0], r[1], r[2]): r[3:] for r in asked}
    assert {(r.p, str(r.start)[:10], str(r.when)[:10]): (r.before_days, r.during_days, r.after_days) for r in got} == want


def test_episodes(spark):
    said = {
        "Alice": "citalopram 01-01, 02-01; fluoxetine 03-01, 04-01; mirtazapine 05-01, 06-01",
        "Bob": "venlafaxine 01-01, 02-01, 03-01, 04-01; mirtazapine 01-01, 02-01; sertraline 03-02, 05-01, 06-01",
        "Chloe": "fluoxetine 01-01, 01-27; venlafaxine 02-01, 01-27",
        "Dave": "fluoxetine 01-01, 01-28; venlafaxine 02-01, 02-28",
        "Elsa": "citalopram 01-01, 02-02; mirtazapine 02-01, 02-28",
        "Fred": "citalopram 01-01, 02-01; mirtazapine 02-01, 02-28",
        "Grace": "citalopram 01-01, 01-28; fluoxetine 02-01, 02-28; venlafaxine 02-02, 03-01; mirtazapine 04-01, 04-28",
    }
    rows = []
    for who, text in said.items():
        for part in text.split("; "):
            drug, _, days = part.partition(" ")
            rows += [(who, drug, f"2018-{d}") for d in days.split(", ")]
    df = spark.createDataFrame([*rows, (None, "x", "2018-01-01"), ("Zoe", None, None)], "p string, drug string, day string").withColumn("day", F.to_date("day"))
    got = two_drug_episodes(df, "p", "drug", "day").collect()
    assert {r.patient_id: (r.drug_a_name, r.drug_b_name) for r in got} == {
        "Alice": ("citalopram", "fluoxetine"),
        "Bob": ("mirtazapine", "sertraline"),
        "Dave": ("fluoxetine", "venlafaxine"),
        "Fred": ("citalopram", "mirtazapine"),
        "Grace": ("citalopram", "fluoxetine"),
    }
    assert two_drug_episodes(df.limit(0), "p", "drug", "day").count() == 0


def test_interval_columns(spark):
    t = [F.lit(at(2015, 1, d)).cast("timestamp_ntz") for d in range(1, 10)]
    assert not one(spark, intervals.overlaps(t[0], t[2], t[2], t[4])) and one(spark, intervals.contiguous(t[0], t[2], t[2], t[4]))
    assert one(spark, intervals.intersection(t[0], t[3], t[5], t[6])) is None
    assert tuple(one(spark, intervals.intersection(t[0], t[3], t[3], t[6]))) == (at(2015, 1, 4), at(2015, 1, 4))
    parts = one(spark, intervals.cut(t[0], t[5], F.array(t[2], t[7])))
    assert [tuple(p) for p in parts] == [(at(2015, 1, 1), at(2015, 1, 3)), (at(2015, 1, 3), at(2015, 1, 6))]
    assert one(spark, intervals.in_units(F.lit(7200.0), "h")) == 2
    with pytest.raises(ValueError):
        intervals.in_units(F.lit(1), "fortnight")
    with pytest.raises(ValueError):
        intervals.subset(spark.range(1), t[0], t[1], flexibility=3)


def test_touching(spark):
    rows = [("a", at(2024, 1, 1), at(2024, 1, 2)), ("a", at(2024, 1, 2), at(2024, 1, 3)), ("a", at(2024, 1, 5), at(2024, 1, 6))]
    df = spark.createDataFrame(rows, "k string, start timestamp_ntz, end timestamp_ntz")
    assert intervals.coalesce(df, ["k"]).count() == 2 and intervals.coalesce(df, ["k"], touching=False).count() == 3
    assert not intervals.any_overlap(df, ["k"]).first().any_overlap


@pytest.mark.parametrize(("x", "dp", "want"), [(-123.51, 0, -124), (-123.5, 0, -123), (-123.49, 0, -123), (-123.456, -1, -120), (-123.456, 1, -123.5), (-0.5, 0, 0), (0.5, 0, 1), (123.456, -1, 120), (123.456, 1, 123.5), (-2.5, 0, -2)])
def test_round_half_up(spark, x, dp, want):
    assert float(one(spark, rounding.round_half_up(F.lit(x), dp))) == want


def test_rounding(spark):
    assert one(spark, rounding.normal_round(F.lit(-2.5))) == -3 and one(spark, rounding.truncate(F.lit(-2.57), 1)) == -2.5
    assert one(spark, rounding.round_sf(F.lit(123456.0), 2)) == 120000
    low, high = one(spark, rounding.roundable_to(F.lit(2.0), 0))
    assert (low, high) == (1.5, 2.5)


def test_rpm():
    assert np.allclose(rpm.best_probabilities(np.zeros(2), np.zeros(2)), 0.5, atol=1e-8)
    assert np.allclose(rpm.best_probabilities(np.array([3, 7]), np.array([7, 3])), [0.04305447, 0.95694553], atol=1e-8)
    assert np.allclose(rpm.best_probabilities(np.array([1, 0]), np.array([0, 1])), [5 / 6, 1 / 6], atol=1e-8)
    assert abs(rpm.best_probabilities(np.array([900, 950, 1000]), np.array([100, 50, 20])).sum() - 1) < 1e-9


def test_columns_letters(spark):
    df = spark.range(20000).select("id", strings.column_letters(F.col("id")).alias("a"))
    known = {r.id: r.a for r in df.filter("id in (0, 25, 26, 51, 52, 701, 702)").collect()}
    assert known == {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA"}
    assert df.filter("id < 18278").filter(strings.column_number(F.col("a")) != F.col("id")).count() == 0


def test_strings(spark):
    x = F.lit("abcabcab")
    assert [one(spark, strings.find_nth(x, "ab", n)) for n in (0, 1, 2, 3)] == [0, 3, 6, -1]
    assert one(spark, strings.split_chunks(F.lit("a\nbcd"), 2)) == ["a\n", "bc", "d"]
    raw = "a\\n\tb\r\n\\"
    assert one(spark, strings.unescape(strings.escape_tabs_newlines(F.lit(raw)))) == raw
    assert one(spark, strings.tsv_pairs(F.lit("A\t1\tb\t2\ta\t3\tx"))) == {"b": "2", "a": "3"}
    assert [one(spark, strings.is_email(F.lit(a))) for a in ("a@b.c", "a@b", "a@b.c.", "a@b@c.d", "a,b@c.d", "")] == [True, False, False, False, False, False]
    assert one(spark, strings.size_text(F.lit(1536.0))) == "1.5KiB"
    assert one(spark, strings.ascii_mangle()(F.lit("Café ñ"))) == "Cafe n"
    assert one(spark, strings.multiple_replace({"a": "b", "b": "a"})(F.lit("abc"))) == "bac"
    assert one(spark, lookup.natural_key(F.lit("a10b"))) > one(spark, lookup.natural_key(F.lit("a9b")))


def test_conversions(spark):
    assert [one(spark, convert.to_bool(F.lit(v))) for v in ("y", "FALSE", "", "0", "2")] == [True, False, None, False, True]
    with pytest.raises(Exception, match="not a truth value"):
        one(spark, convert.to_bool(F.lit("perhaps")))
    assert one(spark, convert.is_valid_nhs(F.lit("943 476 5919"))) and not one(spark, convert.is_valid_nhs(F.lit("9434765918")))
    assert one(spark, convert.from_hex_text(convert.hex_text(F.lit(b"\x01\xff")))) == b"\x01\xff"
    assert one(spark, convert.from_base64_text(convert.base64_text(F.lit(b"\x01\xff")))) == b"\x01\xff"
    assert one(spark, convert.sql_dequoted(convert.sql_string(F.lit("it's")))) == "it's"
    assert one(spark, convert.sql_csv_items(F.lit("'a,b', c, 'd''e'"))) == ["'a,b'", "c", "'d''e'"]
    assert tuple(one(spark, convert.split_sql_type(F.lit("VARCHAR(10)")))) == ("VARCHAR", 10)
    assert convert.spark_type("NVARCHAR(160) COLLATE Latin1_General_CI_AS") == "string" and convert.spark_type("DECIMAL(10, 2)") == "decimal(10,2)"


def test_dates(spark):
    assert tuple(one(spark, dates.duration_from_iso(F.lit("P1Y2M3DT4H5M6.5S")))) == (14, 3 * 86400 + 4 * 3600 + 5 * 60 + 6.5)
    assert one(spark, dates.duration_from_iso(F.lit("P"))) is None
    assert one(spark, dates.duration_to_iso(F.lit(-14), F.lit(-5))) == "-P1Y2MT5S"
    assert one(spark, dates.hours_minutes(F.lit(at(2024, 1, 1)), F.lit(at(2024, 1, 1, 2, 5)))) == "2:05"
    assert one(spark, dates.excel_datetime(F.lit(43831.5))) == at(2020, 1, 1, 12)
    assert one(spark, dates.parse_date(F.lit("03/02/2024"), "dd/MM/yyyy")) == dt.date(2024, 2, 3)


def test_hashes(spark):
    assert hashing.murmur3_many([b"", b"a", b"abcd", b"hello, world"], 0).tolist() == [0, 0x3C2569B2, 0x43ED676A, 0x149BBB7F]
    halves = hashing.murmur3_128_many([b"", b"foo", b"The quick brown fox jumps over the lazy dog"])
    assert [f"{a:016x}{b:016x}" for a, b in zip(*map(np.ndarray.tolist, halves))] == ["0" * 32, "e271865701f545617eaf87e42bba7d87", "e34bbc7bbc071b6c7a433ca9c49a9347"]
    assert one(spark, hashing.murmur64()(F.lit("foo"))) == 0xE271865701F54561 - (1 << 64) and one(spark, hashing.murmur64()(F.lit(None).cast("string"))) is None
    assert one(spark, hashing.make_hasher("", "k")(F.lit("x"))) == one(spark, hashing.keyed("k")(F.lit("x")))
    with pytest.raises(ValueError):
        hashing.make_hasher("MD5", "k")
    assert int(one(spark, hashing.to_signed(F.lit(255), 8))) == -1


def test_filters():
    low = np.array(dsp.lowpass(31, 5, 100))
    assert abs(low.sum() - 1) < 1e-12 and np.allclose(low, low[::-1])
    with pytest.raises(ValueError):
        dsp.highpass(10, 5, 100)


def test_sql_helpers(spark):
    t = spark.createDataFrame([(1, 101), (2, 102)], "a int, b int")
    assert sqlops.count_star(t) == 2 and tuple(sqlops.count_and_max(t, "b").first()) == (2, 102)
    assert sqlops.exists(t, F.col("a") == 1) and not sqlops.exists(t, F.col("a") == 99)
    assert sqlops.count_and_max(t.limit(0), "b").first().largest is None
    assert sorted(sqlops.first_values(t)) == [1, 2]
    parent = spark.createDataFrame([(1, "Parent 1"), (2, "Parent 2")], "id int, name string")
    child = spark.createDataFrame([(1, "Child 1", 1), (2, "Child 2", 2)], "id int, name string, parent_id int")
    both, keys = sqlops.merge_tables(parent, parent, "id")
    kids, _ = sqlops.merge_tables(child, child, "id", {"parent_id": keys})
    assert sorted(map(tuple, both.collect())) == [(1, "Parent 1"), (2, "Parent 2"), (3, "Parent 1"), (4, "Parent 2")]
    assert sorted(map(tuple, kids.select("id", "name", "parent_id").collect())) == [(1, "Child 1", 1), (2, "Child 2", 2), (3, "Child 1", 3), (4, "Child 2", 4)]
    assert sqlops.table_order({"child": ["parent", "child"], "parent": []}) == [["parent"], ["child"]]
    with pytest.raises(ValueError):
        sqlops.table_order({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        sqlops.union_checked(t, parent)


def test_vocabulary(spark):
    edges = spark.createDataFrame([("a", "b", "is a"), ("b", "c", "is a"), ("c", "a", "is a"), ("a", "x", "has")], "child string, parent string, relationship string")
    start = spark.createDataFrame([("a",)], "n string")
    assert sorted((r.ancestor, r.generation) for r in vocab.ancestors(edges, start, ["is a"]).collect()) == [("b", 1), ("c", 2)]
    assert vocab.ancestors(edges, start, ["none"]).count() == 0
    chain = spark.range(1000).selectExpr("id AS child", "id + 1 AS parent", "'is a' AS relationship")
    links = spark.createDataFrame([(7, 500, "is a"), (1000, 990, "is a")], "child long, parent long, relationship string")  # a short cut, a ring
    up = vocab.ancestors(chain.union(links), spark.createDataFrame([(0,), (998,)], "n long"))
    assert up.filter("start = 0").selectExpr("count(*)", "max(generation)", "max(if(ancestor = 1000, generation, 0))").first()[:] == (1000, 508, 508)
    assert sorted((r.ancestor, r.generation) for r in up.filter("start = 998").collect()) == [(990, 3), (991, 4), (992, 5), (993, 6), (994, 7), (995, 8), (996, 9), (997, 10), (999, 1), (1000, 2)]
    assert vocab.ancestors(chain, spark.createDataFrame([(0,)], "n long"), most=5).count() == 5
    concepts = spark.createDataFrame([(1, "one", "A", "a1"), (2, "two", "B", "b2"), (3, "three", "A", "a3")], "concept_id int, concept_name string, vocabulary_id string, concept_code string")
    links = spark.createDataFrame([(3, 1, "Is a"), (3, 2, "Maps to")], "concept_id_1 int, concept_id_2 int, relationship_id string")
    assert vocab.equivalents(concepts, links, "A", ["a1"], "B").count() == 0
    assert vocab.equivalents(concepts, links, "A", ["a1"], "B", descendants=True).first().target_code == "b2"


def test_documents(spark, tmp_path):
    def zipped(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped(word__document_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    message = email.message.EmailMessage()
    message.set_content("plain body")
    message.add_attachment("attached", filename="x.txt")
    files = {"a.docx": docx, "b.html": b"<p>x<script>no</script>y</p>z", "c.eml": message.as_bytes(), "d.bin": b"\x00hello\x01", "e.docx": b"broken", "f.xml": b"<a>1<b>2</b></a>"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hi\na | b" and got["b.html"].text == "xy\nz" and got["d.bin"].text == "hello" and got["f.xml"].text == "1 2"
    assert "plain body" in got["c.eml"].text and "attached" in got["c.eml"].text and got["e.docx"].error.startswith("BadZipFile")
    (tmp_path / "e.docx").unlink()
    members = documents.zip_members(spark, str(tmp_path), zips="*.docx")
    assert documents.openxml_kind(members).first().kind == "docx" and documents.grep_members(members, "Hi").count() == 1
    assert delimited.list_files(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == sum(len(v) for k, v in files.items() if k != "e.docx")


def test_delimited(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n3,4\n"), ("c.csv", "y,x\n3,4\n"), ("d.txt", "# c\n a # b\n\nz\n")):
        (tmp_path / name).write_text(text)
    path = lambda n: str(tmp_path / n)
    assert delimited.merge_csv(spark, [path("a.csv"), path("b.csv")]).count() == 2
    with pytest.raises(ValueError):
        delimited.merge_csv(spark, [path("a.csv"), path("c.csv")])
    assert sorted(r.line for r in delimited.read_code_lines(spark, path("d.txt")).collect()) == ["a", "z"]
    df = spark.createDataFrame([("a\tb\nc", None)], "x string, y string")
    delimited.write_tsv(df, path("out"))
    assert [tuple(r) for r in spark.read.csv(path("out"), sep="\t", header=True).collect()] == [("a\\tb\\nc", None)]
    cells = spark.createDataFrame([("7", "yes", "43831", " ", "1.5")], "a string, b string, c string, d string, e string")
    got = cells.select(delimited.cell(F.col("a"), "int"), delimited.cell(F.col("b"), "bool"), delimited.cell(F.col("c"), "date"), delimited.cell(F.col("d"), "str", default="none"), delimited.cell(F.col("e"), "float")).first()
    assert tuple(got) == (7, True, dt.date(2020, 1, 1), "none", 1.5)
    with pytest.raises(Exception, match="not int"):
        cells.select(delimited.cell(F.col("e"), "int")).collect()


def test_streams(spark, tmp_path):
    rows = [("u", at(2024, 1, 1, 0), "x", 1.0), ("u", at(2024, 1, 1, 0, 30), "x", 2.0), ("u", at(2024, 1, 1, 5), "y", 3.0), ("v", at(2024, 1, 3), "x", 4.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, kind string, v double").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, ts timestamp, kind string, v double").parquet(str(tmp_path / "in"))

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = drained(streams.sessions(stream(), "k", "ts", "1 hour"), "s1")
    assert [(r.k, r.n) for r in sorted(got)] == [("u", 2), ("u", 1)]
    assert len(drained(streams.first_of_each(stream(), "kind", "ts", "10 days"), "s2")) == 2
    assert {(r.kind, r.n) for r in drained(streams.windowed_counts(stream(), "ts", "kind", "v"), "s3")} == {("x", 2), ("y", 1)}


def test_ancestors_of_deep_hierarchies(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "is a") for k in range(25)] + [("n25", "n23", "is a")], "child string, parent string, relationship string")
    start = spark.createDataFrame([("n0",)], "child string")
    assert sorted((r.generation, r.ancestor) for r in vocab.ancestors(edges, start).collect()) == [(k, f"n{k}") for k in range(1, 26)]
    assert vocab.ancestors(edges, start, most=2).count() == 2


def test_more_strings(spark):
    df = spark.createDataFrame([("1.5 K",), ("2 kibi",), ("3 k",), ("7 B",), ("1 Q",)], "t string")
    assert [r[0] for r in df.select(strings.bytes_from_text(F.col("t"))).collect()] == [1536, 2048, 3072, 7, None]
    one = spark.range(1)
    text = lambda c: one.select(c).first()[0]
    assert text(strings.wrapped(10)(F.lit("the quick brown\nfox jumps"))) == "the quick\nbrown fox\njumps" and text(strings.wrapped(0)(F.lit("a  b"))) == "a  b"
    assert [text(strings.column_letters(F.lit(n))) for n in (0, 25, 26, 51, 52, 701, 702, 18277, 18278, 475254)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA", "AAAAA"]
    assert text(strings.column_letters(F.lit(-1))) is None
    assert text(strings.bytes_text(F.lit(9856), "customary_ext")) == "9.6 kilo" and text(strings.bytes_text(F.lit(1.9))) == "1.0 B"


def test_natural_keys_of_long_numbers(spark):
    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a007", "b"]
    df = spark.createDataFrame([(x,) for x in names], "t string")
    got = [r.t for r in df.orderBy(lookup.natural_key(F.col("t"))).collect()]
    assert got == ["a2", "a007", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_upsert_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "e")], "id int, name string")
    assert sorted(map(tuple, sqlops.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_ranges_that_overlap(spark):
    ranges = spark.createDataFrame([(1, 0, 30, "wide"), (0, 10, 20, "first"), (2, 25, 60, "late"), (3, 70, 70, "none")], "ordinal int, low int, high int, label string")
    assert sorted(map(tuple, lookup.disjoint(ranges).collect())) == [(0, 10, "wide"), (10, 20, "first"), (20, 25, "wide"), (25, 30, "wide"), (30, 60, "late")]
    df = spark.createDataFrame([(x, "own") for x in (0, 10, 19, 20, 59, 60, None)], "low int, label string")
    assert [r.low for r in lookup.range_lookup(df.drop("label"), "low", ranges, "semi").orderBy("low").collect()] == [0, 10, 19, 20, 59]
    got = lookup.range_lookup(df.withColumnRenamed("label", "found"), "low", ranges).collect()
    assert {r.low: r.label for r in got} == {0: "wide", 10: "first", 19: "first", 20: "wide", 59: "late", 60: None, None: None}


def test_running_sums_cross_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.col("id").alias("v"))
    got = sqlops.running_sum(df, ["k"], F.col("v"), "s").orderBy("k").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total
    assert len(got) == 1000 and sqlops.running_sum(df.limit(0), ["k"], F.col("v"), "s").count() == 0


def test_whole_columns(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "n int, t string, b boolean")
    assert columns.renamed(df, {"n": "m", "t": None}).columns == ["m", "b"] and columns.prefixed(df, "x").columns == ["xn", "xt", "xb"]
    assert [tuple(r) for r in columns.null_values(df, [1, "a", False]).collect()] == [(None, None, True), (2, None, None)]
    assert [r.t for r in columns.replaced(df, "t", None, "z").collect()] == ["a", "z"]
    try:
        columns.renamed(df, {"q": "m"})
    except KeyError:
        pass
    else:
        raise AssertionError
    assert not columns.same_columns(df, df.drop("b")) and columns.same_columns(df, df.toDF("x", "y", "z"), with_names=False)


def test_versions_sort(spark):
    texts = ["1.10.0", "1.2.0-rc.1", "1.2.0", None, "0.9.9", "1.2"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("v", convert.version(F.col("t")))
    assert [r.t for r in df.filter("v is not null").orderBy("v").collect()] == [None, "0.9.9", "1.2.0-rc.1", "1.2.0", "1.10.0"]
