"""Language ID, mixing, packing, archives and chat against brute force, round trips and held-out labels."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import chat, langid, mixing, packing, queries, warc

SF = "/root/testdata/sf0.001"
CLASH = ("_id", "_h", "_text", "_epoch", "row", "epoch", "h", "first", "digest", "mix", "lot")


def test_model_adds_up():
    text = "the cat sat on the mat and the dog sat too"
    code, _ = langid.codes([text])
    model = langid.Model(*np.unique(code, return_counts=True))
    symbols = np.arange(langid._SYMBOLS)
    for context in (code[5] >> langid.BITS, code[20] >> langid.BITS, 99):
        p = 2 ** model.log2((context << langid.BITS) | symbols)
        assert abs(p.sum() - 1) < 1e-9
    assert (model.log2(code) > -np.log2(langid._SYMBOLS)).mean() > 0.9


def test_model_equals_plain_kneser_ney():
    """Against the textbook's formula over dictionaries: counts at the highest order, below it how many symbols stand before."""
    texts = ["the cat sat on the mat", "a dog and the other dog sat", "mat of the cat"]
    grams = Counter()
    for t in texts:
        symbols = [0, 0, 0, 0, *(0 if c == " " else 1 + ord(c) for c in t), 0]
        grams.update(tuple(symbols[i - 3 : i + 1]) for i in range(4, len(symbols)))
    orders = {4: grams}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    discount = {}
    for n, own in orders.items():
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def probability(gram):
        if not gram:
            return 1 / langid._SYMBOLS
        own, d = orders[len(gram)], discount[len(gram)]
        after = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        if not after:
            return probability(gram[1:])
        return max(own[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * probability(gram[1:])

    packed = lambda g: sum(x << langid.BITS * (3 - k) for k, x in enumerate(g))
    code, n = np.unique(np.concatenate([langid.codes([t])[0] for t in texts]), return_counts=True)
    assert dict(zip(code.tolist(), n.tolist())) == {packed(g): c for g, c in grams.items()}
    rng = random.Random(5)
    letters = sorted({x for g in grams for x in g})
    asked = [*grams, *(tuple(rng.choice([*letters, 1 + ord("z")]) for _ in range(4)) for _ in range(300))]
    got = langid.Model(code, n).log2(np.array([packed(g) for g in asked]))
    assert np.allclose(got, [np.log2(probability(g)) for g in asked], atol=1e-9)


def test_codes():
    code, first = langid.codes(["Ab!! c", "", "d"])
    a, b, c, d = (1 + ord(x) for x in "abcd")
    assert [x & 4095 for x in code] == [a, b, 0, c, 0, 0, d, 0] and first.tolist() == [0, 5, 6, 8]
    assert code[0] == a and code[1] == (a << 12 | b) and code[6] == d  # nothing of the stretch before


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.005
    right, wrong = ([r.score for r in out if (r.lang == r.lang_pred) == x] for x in (True, False))
    assert not wrong or np.mean(right) > np.mean(wrong)


def test_language_odd_rows(spark):
    rows = [(k, "the cat and the dog " * 3, "en") for k in range(20)] + [(k, "der hund und die katze " * 3, "de") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "en"), (None, "the dog", None), (53, "!!! 12", "de"), (54, "die katze", None), (54, "die katze", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in CLASH})
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (1, 21, 50, 51, 53, 54, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(df.limit(0)).count() == 0 and langid.accepted(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_foreign_texts_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 300, 2000) for _ in range(8)]
    foreign = [
        "Tämä on suomenkielinen lause, jota mallit eivät ole oppineet lainkaan.", "Это предложение написано по-русски и ни одна модель не знает таких букв.",
        "To jest zdanie napisane w języku polskim, którego modele nigdy nie widziały.", "Bu cümle Türkçe yazılmıştır ve modeller bu dili hiç öğrenmedi.", "这是一个中文句子，模型没有学过。",
    ]
    rows = [(10**6 + k, x, None) for k, x in enumerate(foreign + noise)]
    rows += [(2 * 10**6 + k, "".join(rng.choice("абвгджзклмн ") for _ in range(80)), lang) for k in range(4) for lang in ("en", "de", "fr", "es")]  # mislabelled
    got = langid.identify(docs.union(spark.createDataFrame(rows, docs.schema))).collect()
    assert all(r.rejected for r in got if 10**6 <= r.doc_id < 2 * 10**6)
    assert np.mean([r.rejected for r in got if r.doc_id < 10**6]) < 0.005


def test_shares_of_models_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(1, "das ist es", "de"), (1, "das ist es", "de"), (7000, None, "en"), (None, "the cat", None), (7001, "unu doi trei", "ro")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    key = lambda **most: sorted(map(tuple, langid.identify(docs, **most).collect()), key=str)
    whole = key()
    assert len(langid.Counts(docs, share_types=2000).ranges) > 5
    assert key(share_types=2000) == whole and len(whole) == docs.count()
    assert {r[3] for r in whole if r[0] == 7001} <= {"ro", "und"}  # a small language keeps its n-grams
    text = "the cat sat on the mat and the dog sat too"
    one = spark.createDataFrame([(text, "en")], "text string, lang string")
    code, n = np.unique(langid.codes([text])[0], return_counts=True)
    counts = langid.Counts(one, share_types=5)
    assert sum(r.n for r in counts.tables[4].collect()) == n.sum()
    want = langid.Model(code, n).log2(code)
    for low, high in counts.ranges:
        own = (langid._middle(code) >= low) & (langid._middle(code) < high)
        assert np.array_equal(counts.share(low, high)[0].log2(code[own]), want[own])


def test_unlabelled_columns_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted(map(tuple, langid.identify(df).select("doc_id", "lang_pred", "score").collect()))
    assert key(docs) == key(other)


def test_mixing_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = "domain, lang, source, doc_id, tokens, epoch, taken"
    got = sorted(map(tuple, queries.op2_hierarchical_mixing(spark, SF).select(*columns.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op2_hierarchical_mixing']})").fetchall())


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)]
    df = spark.createDataFrame(leaves, "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.alloc for r in mixing.budgets(df, ["top", "leaf"], {"top": {"a": 1, "b": 1}}, 600, epochs=1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 290, ("b", "z"): 300}
    got = {r.leaf: r.alloc for r in mixing.budgets(df, ["top", "leaf"], {"top": {"a": 9, "b": 1}}, 1500, epochs=1).collect()}
    assert got == {"x": 10, "y": 1000, "z": 490}  # a is full, so b gets what is left
    assert {r.alloc for r in mixing.budgets(df, ["top", "leaf"], {}, 10**6, epochs=2).collect()} == {20, 2000}


def test_weights_of_zero(spark):
    df = spark.createDataFrame([("a", "x", 100), ("a", "y", 100), ("b", "z", 100)], "top string, leaf string, tokens long")
    split = lambda weights, budget: {r.leaf: r.alloc for r in mixing.budgets(df, ["top", "leaf"], weights, budget, epochs=1).collect()}
    assert split({"top": {"a": 0, "b": 1}}, 150) == {"x": 0, "y": 0, "z": 100}
    assert split({"leaf": {"x": 0}}, 150) == {"x": 0, "y": 75, "z": 75}
    assert split({"leaf": {"x": 0, "y": 0}}, 150) == {"x": 0, "y": 0, "z": 100}
    assert split({"top": {"a": 0, "b": 0}}, 150) == {"x": 0, "y": 0, "z": 0}
    for bad in ({"top": {"a": -1}}, {"leaf": {"x": -2}}):
        try:
            mixing.budgets(df, ["top", "leaf"], bad, 10)
        except ValueError:
            continue
        raise AssertionError


def test_remixed_keeps_prefixes(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice([" ", "\n", "  "]) + f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", "fr"]), f"s{rng.randrange(3)}", -1) for i in range(200)]
    rows += [(7, "a b c", "en", "s1", -1), (7, "a b c", "de", "s2", -1), (8, "q r s t", "fr", "s0", -1), (8, "q r s t", "fr", "s0", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    chosen, want = mixing.mix(mixing.described(df), mixing.LEVELS, mixing.WEIGHTS).collect(), defaultdict(list)
    total = sum(len(r[1].split()) for r in rows)
    assert sum(r.taken for r in chosen) <= total
    for r in chosen:
        want[r.doc_id, r.lang, r.source].append(r.taken)
    got, texts = defaultdict(list), {(r[0], r[2], r[3]): r[1] for r in rows}
    for r in mixing.remixed(df).collect():
        own = texts[r.doc_id, r.lang, r.source]
        assert own.startswith(r.text) and (r.text == own) == (r.n_chars == -1) and r.n_chars in (-1, len(r.text))
        got[r.doc_id, r.lang, r.source].append(len(r.text.split()))
    assert {k: sorted(v) for k, v in got.items() if k[0] != 8} == {k: sorted(v) for k, v in want.items() if k[0] != 8}
    assert sum(got[8, "fr", "s0"]) <= sum(want[8, "fr", "s0"]) and any(t < r.tokens for r in chosen for t in [r.taken])


def test_mixing_odd_rows(spark):
    rows = [(1, None, "en", "s1"), (2, "a b c", None, None), (2, "a b c", None, None), (None, "x y", None, ""), (3, "", "en", "s1"), (4, "a " * 40, "de", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})
    got = mixing.mix(mixing.described(df), mixing.LEVELS, mixing.WEIGHTS, budget=20).collect()
    assert sum(r.taken for r in got) <= 20 and all(0 <= r.taken <= r.tokens for r in got)
    assert mixing.remixed(df).columns == df.columns
    everything = mixing.mix(mixing.described(df), mixing.LEVELS, {}, budget=10**6)
    assert everything.filter("tokens > 0").count() == 2 * 4
    assert mixing.mix(mixing.described(df.limit(0)), mixing.LEVELS, {}).count() == 0 and mixing.remixed(df.limit(0)).count() == 0


def test_prefixes_use_the_whole_budget(spark):
    docs = spark.range(500).select(F.lit("d").alias("leaf"), F.col("id").alias("doc_id"), F.lit(1).alias("h"), (F.col("id") % 7).alias("tokens"))
    total = docs.agg(F.sum("tokens")).first()[0]
    for budget in (1, total // 3, total, 2 * total - 5):
        got = mixing.mix(docs, ["leaf"], {}, budget=budget).collect()
        assert sum(r.taken for r in got) == budget and sum(r.taken < r.tokens for r in got) <= 1


WORDS = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x85　.,'!sStTdDlLrReEvVmMaAé́İßΣς12²中<|>x", max_size=20))
def test_word_ids(text):
    assert WORDS.text(text.encode()) == WORDS.whole(text)


NO_ENDS = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
NO_ENDS.is_last[:] = False


class Counted:
    """A tokenizer that counts the calls for texts."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode(self, *args, **more):
        self.calls += 1
        return self.inner.encode(*args, **more)

    def encode_batch_fast(self, *args, **more):
        self.calls += 1
        return self.inner.encode_batch_fast(*args, **more)


def test_new_words_share_calls():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.tokenizer = counted = Counted(words.tokenizer)
    text = " ".join(f"w{chr(97 + k % 26)}é{chr(97 + k // 26)}ñ{mark}" for k in range(600) for mark in ("", ".", ",###", "!!"))
    want = np.array(counted.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.text(text.encode()) == want and counted.calls <= 10
    words.trim(0)
    before = counted.calls
    assert words.text(text.encode()) == want and counted.calls <= before + 1  # what is met again isn't lost with its generation
    for other in (b"other", b"another"):
        words.trim(0)
        words.text(other)
    assert {*words, *words.before} == {b"other", b"another"}  # what isn't met for two generations is gone


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n.,'!#<|sStTéÉßÿÞ×÷ªµİǅΣ\u0301\u0338\u00a012²中", max_size=12), max_size=4))
def test_word_ids_of_several_texts(texts):
    for words in (WORDS, NO_ENDS):
        words.clear()
        assert words.texts([t.encode() for t in texts]) == [words.whole(t) for t in texts]


def test_best_fit():
    assert packing.best_fit([6, 5, 4, 5, 3], 10, 9) == ([0, 1, 0, 1, 2], [0, 0, 6, 5, 0])
    assert packing.best_fit([6, 5, 4], 10, 1) == ([0, 1, 1], [0, 0, 5])  # the first is closed
    rng = random.Random(0)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    bins, places = packing.best_fit(sorted(sizes, reverse=True), 100, 4000)
    assert max(bins) + 1 <= 1.01 * sum(sizes) / 100 + 1
    ends = defaultdict(int)
    for b, p, s in zip(bins, places, sorted(sizes, reverse=True)):
        assert p == ends[b]
        ends[b] += s
    assert max(ends.values()) <= 100


def test_fullest_closes_in_the_query():
    """With the query's own number of open sequences: more half-full ones than that, so the fullest close."""
    sizes = [1100 + k for k in range(packing.OPEN + 40)]
    bins, _ = packing.best_fit([*sizes, *(2048 - s for s in sizes)], packing.LENGTH, packing.OPEN)
    assert bins[: len(sizes)] == list(range(len(sizes)))
    closed = set(range(40 + packing.OPEN)) - set(bins[len(sizes) :])
    assert len(closed) >= 40 and sum(b < len(sizes) for b in bins[len(sizes) :]) == packing.OPEN


def packed_right(rows, got, length=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= length
    return len(filled), -(-sum(r.length for r in got) // length)


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = packed_right(rows, queries.op9_best_fit_packing(spark, SF).collect())
    assert used <= 1.01 * least + 1


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack(df, group_docs=100).toPandas()
    assert len(got) == 4000 and (got.sequence_id // (1 << 32)).value_counts().max() < 300


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x, y. <|endoftext|> Z"), (3, "x, y. <|endoftext|> Z"), (4, "word " * 5000), (5, "w " * 2047)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    packed_right(rows, packing.pack(df, group_docs=3).collect())
    assert packing.pack(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://a b\r\nq", "x"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "\n"), (7, "u", "\r\n\r\n"), (None, "u", "x"), (2, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    got = warc.resolve_revisits(df, str(tmp_path / "w")).collect()
    most = defaultdict(lambda: -1)
    for i, _, h in rows:
        most[h or ""] = max(most[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), most[h or ""]
        again = i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    payloads = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == payloads[r.page_id] for r in got if r.record_type == "response")
    alone = warc.resolve_revisits(df, str(tmp_path / "v"), least_bytes=1).collect()
    assert {r.record_type for r in alone if r.payload_bytes == 0} == {"response"}
    assert warc.resolve_revisits(df.limit(0), str(tmp_path / "e")).count() == 0


def test_archives_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op6_warc_revisits(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].payload_digest == base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode()


def test_archives_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    got = queries.op6_warc_revisits(spark, SF).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op6_warc_revisits']})").fetchall())


def test_canonical_numbers():
    known = {1e21: "1e+21", 1e20: "100000000000000000000", 0.1: "0.1", 1e-7: "1e-7", 1e-6: "0.000001", 123.0: "123", 1.5e300: "1.5e+300", -0.0: "0", 333333333.33333329: "333333333.3333333", 5e-324: "5e-324", -12.25: "-12.25"}
    assert {x: chat.canonical(x) for x in known} == known


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=10))
def test_canonical_round_trip(value):
    text = chat.canonical(value)
    assert json.loads(text, parse_int=float) == value and chat.canonical(json.loads(text)) == text


def test_canonical_refuses_what_has_no_form():
    assert chat.canonical(10**25) == "1e+25" and chat.canonical(2**53 + 1) == "9007199254740992" and chat.canonical(True) == "true"
    for bad in ("\ud800", {"\udfff": 1}, [float("nan")], 10**400):
        try:
            chat.canonical(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_odd_arguments_are_errors_not_crashes(spark):
    odd = ['{"text":"\\ud800"}', '{"text":1e999}', "[" * 100_000, '{"text":12345678901234567890123}', '{"text":NaN}', "{" + '"text":{' * 900 + "}" * 901]
    df = spark.createDataFrame([(k, 0, "call", "a", "t", x, None, None) for k, x in enumerate(odd)], "conv_id long, turn int, role string, call_id string, name string, arguments string, after array<string>, content string")
    got = {r.conv_id: r for r in chat.link_calls(df, {"t": {"type": "object"}}).collect()}
    assert [got[k].errors for k in range(len(odd))][:5] == ["arguments: not JSON"] * 3 + ["", "arguments: not JSON"]
    assert json.loads(json.loads(got[3].json)["tool_calls"][0]["function"]["arguments"]) == {"text": 1.2345678901234568e22}
    assert json.loads(got[0].json)["tool_calls"][0]["function"]["arguments"] == odd[0]


def test_more_schema_keywords():
    found = lambda v, s: list(chat.faults(v, s))
    assert found(1, {"const": True}) and found(1.0, {"const": 1}) == [] and found("abc", {"pattern": "^b"}) and not found("abc", {"pattern": "b"})
    assert found(3, {"exclusiveMinimum": 3}) and not found(3, {"exclusiveMaximum": 4}) and found(0.3, {"multipleOf": 0.2}) and not found(0.6, {"multipleOf": 0.2})
    assert found(1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}) and not found(1, {"anyOf": [{"type": "string"}, {"minimum": 1}]})
    assert found(1, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}) and found(1, {"not": {"type": "integer"}}) and found(1, {"allOf": [{"minimum": 2}]})
    tree = {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"in": {"$ref": "#/$defs/t"}}, "additionalProperties": {"type": "integer"}}}}
    assert not found({"in": {"in": {"a": 1}}}, tree) and found({"in": {"in": {"a": "x"}}}, tree) == ["$.in.in.a: not integer"]
    assert found([1, 1.0], {"uniqueItems": True}) and found({}, {"minProperties": 1})
    for bad in ({"typo": 1}, {"items": {"typo": 1}}, {"anyOf": [{"typo": 1}]}):
        try:
            chat.check_schema(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_faults():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 0}, "b": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}, "c": {"type": "string", "minLength": 2}}}
    found = lambda v: list(chat.faults(v, schema))
    assert found({"a": None, "b": [1], "c": "xy"}) == []
    assert found([]) == ["$: not object"] and found({}) == ["$.a: missing"]
    assert found({"a": -1, "b": [1, 3, 1], "c": "x", "d": 0}) == ["$.a: out of bounds", "$.b: length 3", "$.b[1]: not among the values", "$.c: length 1", "$.d: unknown"]
    assert found({"a": True}) == ["$.a: not ['integer', 'null']"]


def test_tool_calls(spark):
    rows = [
        (1, 0, "call", "a", "t", '{"b":1, "a":2.0}', None, None), (1, 1, "result", "a", None, None, None, "ok"), (1, 2, "call", "b", "t", "{}", ["a", "zz"], None),
        (1, 3, "call", "c", "t", "nope", ["d"], None), (1, 4, "call", "d", "u", '{"a":1}', ["c"], None), (1, 5, "result", "d", None, None, None, "r"),
        (1, 6, "result", "q", None, None, None, "r"), (1, 7, "user", None, None, None, None, 'hé"\n'), (None, 1, "call", "a", "t", None, None, None),
        (1, 9, "call", "a", "t", "{}", None, None), (1, 9, "result", "a", None, None, None, "again"), (1, 1, "result", "a", None, None, None, "ok"),
        (2, 0, None, None, None, None, None, None), (1, 10, "call", "e", "t", '{"a":1}', ["b"], None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, call_id string, name string, arguments string, after array<string>, content string").withColumns({c: F.lit("x") for c in CLASH})
    got = chat.link_calls(df, {"t": {"type": "object", "required": ["a"]}}).collect()
    assert len(got) == len(rows)
    by_turn = {(r.conv_id, r.turn, r.role): r for r in got}
    said = {k: (r.level, r.linked_turn, r.status, r.errors) for k, r in by_turn.items()}
    ring = "after: waits in a ring"
    assert said == {
        (1, 0, "call"): (0, 1, "answered", ""), (1, 1, "result"): (1, 0, "linked", ""), (1, 2, "call"): (2, None, "unanswered", "$.a: missing"),
        (1, 3, "call"): (None, None, "unanswered", f"{ring}; arguments: not JSON"), (1, 4, "call"): (None, 5, "answered", f"{ring}; name: no such tool"),
        (1, 5, "result"): (None, 4, "linked", ring), (1, 6, "result"): (0, None, "orphan", ""), (1, 7, "user"): (0, None, "message", ""),
        (None, 1, "call"): (0, None, "unanswered", "$.a: missing"), (1, 9, "call"): (0, 1, "duplicate", "$.a: missing"), (1, 9, "result"): (1, 0, "duplicate", ""),
        (2, 0, None): (0, None, "message", ""), (1, 10, "call"): (4, None, "unanswered", ""),
    }
    assert json.loads(by_turn[1, 0, "call"].json)["tool_calls"][0]["function"]["arguments"] == '{"a":2,"b":1}'
    assert chat.link_calls(df.limit(0), {}).count() == 0


def test_tool_calls_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    there = {(r.conv_id, r.turn): r for r in turns}
    for r in queries.op8_tool_call_linking(spark, SF).collect():
        own, before = there[r.conv_id, r.turn], r.turn
        if own.role == "user":
            depth = 0
            while (r.conv_id, before - 2) in there and there[r.conv_id, before - 2].role == "user":
                before, depth = before - 2, depth + 1
            answered = (r.conv_id, r.turn + 1) in there and there[r.conv_id, r.turn + 1].role == "assistant"
            assert (r.level, r.status) == (2 * depth, "answered" if answered else "unanswered") and not r.errors
            assert json.loads(json.loads(r.json)["tool_calls"][0]["function"]["arguments"]) == {"turn": r.turn, "text": own.text}
        elif own.role == "assistant":
            assert r.linked_turn == r.turn - 1 and json.loads(r.json) == {"role": "tool", "tool_call_id": f"{r.conv_id}-{r.turn - 1}", "content": own.text}
        else:
            assert json.loads(r.json) == {"role": own.role, "content": own.text}


def test_depths(spark):
    rng = random.Random(8)
    after = {0: []}
    for i in range(1, 120):  # chains, forks, calls that wait for several, waits for unknown calls
        after[i] = rng.sample(range(max(0, i - 6), i), min(i, rng.choice([0, 1, 1, 1, 1, 1, 2, 3])))
    after |= {200: [], **{i: [i - 1] for i in range(201, 270)}, 300: [302], 301: [300], 302: [301], 303: [302, 5], 304: [303], 305: [305], 306: [999]}
    depth = {}
    while more := {i: 1 + max((depth[w] for w in ws if w in after), default=-1) for i, ws in after.items() if i not in depth and all(w in depth or w not in after for w in ws)}:
        depth |= more
    df = spark.createDataFrame([(c, str(i), [str(w) for w in ws]) for c in (1, 2) for i, ws in after.items()], "conv_id long, call_id string, after array<string>")
    got = chat._depths(df).collect()
    assert sorted((r.conv_id, int(r.call_id), r.depth) for r in got) == sorted((c, i, d) for c in (1, 2) for i, d in depth.items())


def test_scores_are_right_as_often_as_they_say(spark):
    """On documents that nothing was learned from, by buckets of the score."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    found = langid.identify(docs).filter("held_out").select("doc_id", "lang_pred", "score").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    found["right"], found["bucket"] = found.lang == found.lang_pred, found.score.round(2)
    for bucket, own in found.groupby("bucket"):
        if len(own) >= 200:
            assert abs(own.right.mean() - own.score.mean()) < 0.01, (bucket, len(own), own.right.mean())
    assert abs(found.right.mean() - found.score.mean()) < 0.01 and found.score.max() > 0.99


def test_a_prior_counts_once_a_pool():
    fit = langid._monotone(np.array([1, 0, 5, 60, 30, 3]), np.array([2, 2, 10, 60, 30, 3]), 0.25)
    assert np.allclose(fit, [1 / 4, 1.5 / 6, 5.5 / 12, 60.5 / 62, 90.5 / 92, 93.5 / 95])
    assert (np.diff(langid._monotone(np.array([99, 1]), np.array([100, 1]), 0.25)) >= 0).all()
