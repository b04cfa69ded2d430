"""Both vector searches against brute force."""

from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import multiprobe, queries, va_file
from strandline.llm.multiprobe import Hashes, probes
from strandline.llm.va_file import approximation, cell_scores

SF = "/root/testdata/sf0.001"
INF = float("inf")
#: Equal rows, unusable vectors, other dimensions, null ids.
ODD = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [3.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [INF, 1.0]), (None, [1.0, 2.0]), (6, [0.0, 0.0]), (7, [-1e3, 1e3]), (20, [5.0])]


def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "dim": F.lit(2)})


def brute(rows, nth, k):
    """(query, rank, id, score) over (id, vector) rows."""
    out = []
    for q, v in sorted({r[0]: r[1] for r in rows if r[0] % nth == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-300, 300, (200, 9)), rng.integers(-300, 300, (20, 9))
    gaps = []
    for bits in (1, 3, 6):
        low = x.min(axis=0)
        width = np.maximum(1, -(-(x.max(axis=0) - low + 1) >> bits))
        cells = approximation(x, low, width)
        assert cells.max() < 1 << bits
        corner, under, over = cell_scores(q, cells, low, width)
        assert (corner + under[:, None] <= q @ x.T).all() and (corner + over[:, None] >= q @ x.T).all()
        gaps.append((over - under).mean())
    assert gaps[0] > 4 * gaps[1] > 16 * gaps[2]


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The scan leaves a small part of the vectors, and the limit of the first lot all but a few of those."""
    read = []
    monkeypatch.setattr(va_file, "stored", lambda df, name, keep=va_file.stored: read.append((name, out := keep(df, name))) or out)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    assert va_file.search_every(df).count() == 40 * 5
    tables = dict(read)
    assert tables["bounds"].count() < 0.1 * 40 * 2000 and tables["first"].count() <= 40 * 5 * va_file.FIRST


@pytest.mark.parametrize("rows", [1, 40, 700])
def test_va_file(spark, rows):
    rng = np.random.default_rng(rows)
    data = [(i, (rng.standard_normal(5) if i % 3 else np.eye(5)[0]).tolist()) for i in range(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = va_file.top_k(va_file.scaled(df), va_file.scaled(df).filter("vec_id % 50 = 0"), 5, group_rows=200, query_rows=4)
    want = brute([(i, [int(np.floor(256 * x)) for x in v]) for i, v in data], 50, 5)
    assert sorted(map(tuple, got.collect())) == want


def test_va_file_odd_rows(spark):
    usable = [(i, [int(256 * x) for x in v]) for i, v in ODD if i is not None and v and None not in v and INF not in v]
    assert sorted(map(tuple, va_file.search_every(odd(spark)).select("query_id", "rank", "vec_id", "score").collect())) == brute(usable, 50, 5)
    assert va_file.search_every(odd(spark).limit(0)).count() == 0


def test_va_file_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op1_va_file_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op1_va_file_top_k"]).fetchall())


def test_probing_order():
    hashes = Hashes(5, 2, 6, 3.0, 1)
    place = hashes.places(1, np.random.default_rng(3).standard_normal((4, 6)))
    got = probes(place, hashes.mix[1], 30)
    for q, own in zip(place, got):
        part, cost = q - np.floor(q), {}
        for moves in product((-1, 0, 1), repeat=6):
            x = (np.floor(q) + moves + 0.5)[None] - hashes.shift[1]
            # the middle of the perturbed bucket, hashed as a vector would be
            name = int(hashes.buckets(1, np.linalg.lstsq(hashes.lines[1].T, x[0] * hashes.width, rcond=None)[0][None])[0])
            cost[name] = min(cost.get(name, 9), sum(0 if m == 0 else (1 - p) ** 2 if m == 1 else p**2 for m, p in zip(moves, part)))
        want = sorted(cost.values())[:30]
        assert np.allclose([cost[x] for x in own.tolist()], want) and len(set(own.tolist())) == 30


def searched(df, **settings):
    vectors = multiprobe.candidates(df.select("vec_id", "embedding"))
    return multiprobe.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, **settings)


def truth(df, nth=20, k=20):
    pdf = df.toPandas().sort_values("vec_id")
    x, ids = np.vstack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    score = x[ids % nth == 0] @ x.T
    score[np.arange(len(score)), np.flatnonzero(ids % nth == 0)] = -INF
    return ids, score, {q: set(ids[np.lexsort((ids, -s))[:k]].tolist()) for q, s in zip(ids[ids % nth == 0].tolist(), score)}


def test_multiprobe_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, score, want = truth(df)
    got = multiprobe.search_every(df.select("vec_id", "embedding")).toPandas()
    hits = 0
    for s, (q, top) in zip(score, want.items()):
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [s[ids == i][0] for i in own.vec_id], atol=1e-12)
        hits += len(top & set(own.vec_id.tolist()))
    assert hits / (20 * len(want)) >= 0.9


def test_multiprobe_visits_buckets_only(spark):
    """With few probes the search sees a small part of the vectors, and finds neighbours that share a bucket with the query."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = np.repeat(centres, 50, axis=0) + 0.25 * rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "vec_id long, embedding array<double>")
    ids, _, want = truth(df)
    found = {}
    for name, own in {"whole": {}, "split": {"lot_rows": 300, "lot_visits": 40}}.items():
        got = searched(df, most=30, tables=8, hashes=18, **own).toPandas()
        found[name] = sorted(map(tuple, got.to_numpy().tolist()))
        assert sum(len(want[q] & set(g.vec_id.tolist())) for q, g in got.groupby("query_id")) / (20 * len(want)) >= 0.9
    assert [r[:3] for r in found["whole"]] == [r[:3] for r in found["split"]]
    hashes = Hashes(32, 8, 18, multiprobe.WIDTH, multiprobe.SEED)
    y = np.hstack([np.vstack(df.toPandas().embedding), np.zeros((3000, 1))])
    seen = np.zeros((150, 3000), bool)
    for t in range(8):
        bucket, asked = hashes.buckets(t, y), probes(hashes.places(t, y[::20]), hashes.mix[t], 30)
        seen |= (bucket[None, None, :] == asked[:, :, None]).any(axis=1)
    assert seen.mean() < 0.1


def test_multiprobe_many_copies(spark):
    rows = [(i, [1.0, 0.5]) for i in range(300)] + [(i, [1.0, -float(i)]) for i in range(300, 340)] + [(20, [1.0, 0.5])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, v) for i, v in rows if i != 20] + [(20, [1.0, 0.5])] * 31
    got = sorted(map(tuple, multiprobe.search_every(df).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(usable, 20, 20)


def test_multiprobe_odd_rows(spark):
    usable = [(i, v) for i, v in ODD if i is not None and v and None not in v and INF not in v and any(v)]
    got = sorted(map(tuple, multiprobe.search_every(odd(spark)).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(usable, 20, 20)
    assert multiprobe.search_every(odd(spark).limit(0)).count() == 0
