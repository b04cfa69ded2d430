"""Deduplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandline.llm import common, line_dedup, queries, simhash, suffix_dedup
from strandline.llm.common import components

SF = "/root/testdata/sf0.001"
CLASH = ("_id", "_h", "_text", "row", "spans", "fp", "root", "n", "digest")


def shingle_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """Smallest reachable index over prints within three bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ p) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}


def test_fingerprints():
    for text in ("", None, " \n", "a", "A b", "Hello wORLD É x y", "a b c d e f g h " * 30, "x" * 5000, "Ünï\x0bc\x1co d"):
        assert simhash.fingerprint((text or "").encode()) == shingle_print(text)


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    prints = []
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(25):
            prints.append(base)
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                base = base ^ np.uint64(1 << int(k))
    prints = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = defaultdict(set)
    for p, g in zip(prints.view(np.int64).tolist(), groups_of(prints)):
        want[g].add(p)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for hot in (10**6, 2):
        got = defaultdict(set)
        for r in components(simhash.links(df, hot, 400)).collect():
            got[r.component].add(r.node)
        assert {frozenset(v) for v in got.values()} == want


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, " "), (901, " "), (902, "Zz"), (7, "Zz"), (903, "q w e r t y " * 9), (904, "q w e r t y " * 9 + "u")]
    df = spark.createDataFrame([*rows, (None, "alone here")], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    prints = np.array([shingle_print(t) for _, t in rows], np.uint64)
    least = defaultdict(lambda: 10**9)
    groups = groups_of(prints)
    for (i, _), g in zip(rows, groups):
        least[g] = min(least[g], i)
    want = sorted((i, int(p), least[g]) for (i, _), p, g in zip(rows, prints, groups))
    got = simhash.near_duplicates(df, group_rows=100).collect()
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = simhash.one_of_each(df)
    first = stage_groups([t for _, t in rows])  # the stage links other pairs: similar ones, of more bits in more fingerprints
    smallest = {g: min(i for (i, _), f in zip(rows, first) if f == g) for g in set(first)}
    assert kept.columns == df.columns and kept.count() == len(smallest) + 1
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(smallest.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def plain_prints(text, prints=10):
    """The stage's fingerprints, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    grams = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    most = (1 << 64) - 1

    def mixed(x, salt):
        if salt == 0:
            return x
        x ^= salt * 0x9E3779B97F4A7C15 & most
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ x >> 27) * 0x94D049BB133111EB & most
        return x ^ x >> 31

    return [sum(1 << b for b in range(64) if 2 * sum(mixed(x, k) >> b & 1 for x in h) > len(h)) for k in range(prints)]


def stage_groups(texts):
    """The first of each text's group: linked are pairs of a similarity of 0.8 within 7 bits in any fingerprint."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    prints = np.array([plain_prints(t or "") for t in texts], np.uint64)
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= 7).any(axis=1)):
            if j > i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) and first[i] != first[j]:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    return first


def test_several_prints():
    for text in ("", "one", "a b c d e", "a b c d e f g " * 80, " ".join(f"w{k}" for k in range(700))):
        assert simhash.several_prints(text.encode()).tolist() == plain_prints(text)


def test_recall_of_similar_texts_by_band(spark):
    """Of all pairs of different texts of a table, by exact search: those of 0.8 and more that have one root."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts, root = {}, {r.doc_id: r.root for r in simhash.similar(docs).collect()}
    for r in docs.collect():
        texts.setdefault(r.text or "", r.doc_id)
    sets = {i: simhash._shingles(t.encode(), 5) for t, i in texts.items()}
    value, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    frequency = dict(zip(value.tolist(), count.tolist()))
    holders, pairs = defaultdict(list), set()
    for i, own in sets.items():  # similar sets share one of their rarest fifth
        rare = sorted(own.tolist(), key=lambda x: (frequency[x], x))[: len(own) - -(-4 * len(own) // 5) + 1]
        for x in rare:
            pairs.update((j, i) for j in holders[x])
            holders[x].append(i)
    bands = defaultdict(list)
    for i, j in pairs:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        alike = both / (len(sets[i]) + len(sets[j]) - both)
        if alike >= 0.8:
            bands[min(int(20 * alike + 1e-9), 19) / 20].append(root[i] == root[j])
    found = [x for band in bands.values() for x in band]
    print({b: (sum(x), len(x)) for b, x in sorted(bands.items())})
    assert len(found) > 40 and sum(found) >= 0.9 * len(found)
    assert all(sum(x) >= 0.85 * len(x) for x in bands.values() if len(x) >= 30)


def test_one_of_each_finds_similar_texts(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), rng.choice([1, 2, 3, 30])):
            other[at] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs.append((words, other))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k, (a, b) in enumerate(pairs):
        bits = [plain_prints(" ".join(x)) for x in (a, b)]
        same = len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) and any((x ^ y).bit_count() <= 7 for x, y in zip(*bits))
        assert 2 * k in kept and (2 * k + 1 in kept) != same
    assert sum(2 * k + 1 not in kept for k, (a, b) in enumerate(pairs) if (shingle_print(" ".join(a)) ^ shingle_print(" ".join(b))).bit_count() > 3) > 5
    # of few different words: near in bits, but not similar
    rows = [(k, "a b c d e f g " * 60 + " ".join(f"x{k}y{i}" for i in range(7))) for k in range(8)]
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    assert all((p ^ q).bit_count() <= 7 for p in prints for q in prints)
    assert simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 8


def test_large_groups_are_compared_in_blocks(spark):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 3000, 300)]
    rows = []
    for k in range(120):  # a chain: each text changes one more word, so the ends aren't similar but all are linked
        base[(7 * k) % 300] = f"x{k}"
        rows.append((k, " ".join(base)))
    rows += [(200 + k, " ".join(f"y{j}" for j in rng.integers(0, 3000, 300))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda found: sorted(sorted(r.doc_id for r in found if r.root == root) for root in {r.root for r in found})
    whole = groups(simhash.similar(df).collect())
    assert max(map(len, whole)) > 50
    for limits in ({"block_rows": 40}, {"block_bytes": 50_000}):
        assert groups(simhash.similar(df, **limits).collect()) == whole


def test_wide_links_lose_none(spark):
    rng = np.random.default_rng(4)
    prints = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 8), replace=False))) for b in rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(12)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    near = {(int(p), int(q)) for p in prints for q in prints[np.bitwise_count(prints ^ p) <= 7] if p < q}
    root = {int(p): int(p) for p in prints}
    for p, q in sorted(near) * 8:
        root[p] = root[q] = min(root[p], root[q])
    want = {frozenset(x for x in root if root[x] == r) for r in set(root.values())}
    for hot in (10**6, 2):
        got = defaultdict(set)
        for r in components(simhash.links(df, hot, 400, 7, 8)).collect():
            got[r.component].add(r.node & (1 << 64) - 1)
        assert {frozenset(v) for v in got.values()} == {g for g in want if len(g) > 1}


def removed_by_hand(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(30):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        strings += strings[:1] * (trial % 3)
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        order, rank = suffix_dedup.suffix_array(data, starts, ends)
        suffixes = [(data[i:e].tobytes(), s) for s, (b, e) in enumerate(zip(starts, ends)) for i in range(b, e)]
        place = [i for b, e in zip(starts, ends) for i in range(b, e)]
        text = dict(zip(place, suffixes))
        assert [text[i] for i in order] == sorted(suffixes) and (rank[order] == np.arange(len(order))).all()
        shared = suffix_dedup.common_prefixes(data, starts, ends, order, rank, 400, lane=7)
        for a, b in zip(order, order[1:]):
            x, y = text[a][0], text[b][0]
            n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert shared[b] == n


def test_suffix_dedup(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghé\0 ") for _ in range(n))
    passages, rows = [some(60) for _ in range(4)], []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += rng.choice([some(rng.randint(1, 50)), rng.choice(passages)[rng.randint(0, 20) : rng.randint(35, 60)], "ab" * rng.randint(1, 40)])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, passages[0]), (7, "other" + passages[1]), (200, "x" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    for shard in (100_000, 150):  # the small one cuts hot anchors into several shards
        got = suffix_dedup.suffix_dedup(df, length=30, gram=8, shard_bytes=shard)
        assert sorted(map(tuple, got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == removed_by_hand(rows, 30)
    left = suffix_dedup.without_repeats(df.withColumn("n_chars", F.lit(-1)), length=30)
    assert left.columns == [*df.columns, "n_chars"] and left.count() == len(rows)
    assert all((r.n_chars or 0) == len(r.text or "") for r in left.collect())
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_suffix_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op7_suffix_array_dedup(spark, SF).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == removed_by_hand(rows, 400)
    whole = dict(rows)
    assert all(r.text == (whole[r.doc_id] or "") for r in got if not r.n_removed) and all(r.n_bytes - r.n_removed - 6 * r.n_spans <= len(r.text.encode()) <= r.n_bytes - r.n_removed for r in got)


def test_line_dedup(spark):
    rows = [(1, "a b\nC  d\n\nx"), (2, "c d\nq"), (None, "c D"), (3, None), (4, ""), (2, "c d\nq"), (0, "zz yy\nzz  YY")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = line_dedup.line_dedup(df, least_words=2).collect()
    want = [(0, 2, "zz yy", [(1, 6, 12)]), (1, 4, "a b\nC  d\n\nx", []), (2, 2, "q", [(0, 0, 3)]), (2, 2, "q", [(0, 0, 3)]), (3, 0, None, []), (4, 1, "", []), (None, 1, "", [(0, 0, 3)])]
    assert sorted([(r.row.doc_id, r.n_units, r.kept_text, [tuple(s) for s in r.removed]) for r in got], key=str) == sorted(want, key=str)
    late = line_dedup.line_dedup(df.withColumn("place", -F.col("doc_id")), least_words=2, rank="place").collect()
    assert next(r.kept_text for r in late if r.row.doc_id == 1) == "a b\n\nx"
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert line_dedup.line_dedup(df, unit="paragraph", least_words=2).filter("size(removed) > 0").count() == 0
    short = spark.createDataFrame([(1, "a\n\n b \n"), (2, "B\n\nA\nc\n \n"), (3, "x y\n\t\nq"), (4, "q\n\nX  y")], "doc_id long, text string")
    assert {r.row.doc_id: r.kept_text for r in line_dedup.line_dedup(short).collect()} == {1: "a\n\n b \n", 2: "\nc\n \n", 3: "x y\n\t\nq", 4: ""}
    assert {r.row.doc_id: r.kept_text for r in line_dedup.line_dedup(short, unit="paragraph").collect()}[4] == ""


def test_line_dedup_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = "doc_id, n_units, n_removed, removed, kept, text"
    got = queries.op3_line_dedup(spark, SF).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op3_line_dedup']})").fetchall())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM (VALUES (1, NULL), (2, ''), (3, 'a'), (4, 'A')) t(doc_id, text)")
    assert con.execute("SELECT count(*) FROM (" + queries.ORACLE_SQL["op3_line_dedup"] + ")").fetchone() == (4,)


def test_hot_keys_are_dealt_over_shares(spark):
    left = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 0, id % 5000) AS k")
    right = left.groupBy("k").count().withColumn("name", F.col("k") * 2)
    found = common.join_hot(left, common.stored(right, "right"), "k", ["id"], "count")
    assert found.columns == ["k", "id", "name"] and found.count() == 30_000
    assert found.filter("name <> k * 2 OR k <> if(id % 3 = 0, 0, id % 5000)").count() == 0
    assert "_share" in found._jdf.queryExecution().optimizedPlan().toString()
    few = left.filter("id < 900")
    assert common.join_hot(few, common.stored(few.groupBy("k").count(), "right"), "k", ["id"], "count").count() == 900
    assert common.join_hot(left.limit(0), common.stored(right.limit(0), "right"), "k", ["id"], "count").collect() == []
