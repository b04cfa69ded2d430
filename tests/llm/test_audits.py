"""Filter interactions and whitening against brute force."""

import re
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from strandline.llm import interactions, queries, whitening

SF = "/root/testdata/sf0.001"
INF = float("inf")


def brute_audit(docs, labels, part):
    """Every order applied to every document, one filter after another."""
    good, toxic = ({i for i, *x in labels if x[at] == 1} for at in (0, 1))
    failing = []
    for doc_id, text, own in docs:
        if (own or "") != part:
            continue
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any((u or "") == t and j is not None and doc_id is not None and j < doc_id for j, u, _ in docs)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        failing.append((doc_id, {f for f, b in zip("ABCDE", bad) if b}))
    out, sums = [], dict.fromkeys("ABCDE", 0)
    for order in permutations("ABCDE"):
        left = list(failing)
        for step, f in enumerate(order, 1):
            gone = [d for d in left if f in d[1]]
            left = [d for d in left if f not in d[1]]
            sums[f] += len(gone)
            fails = [d for d in failing if f in d[1]]
            out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in failing), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)])
    return [(*r, sums[r[1][r[2] - 1]]) for r in out]


def test_audit_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(200))
    docs = [
        (1, long, "en"), (2, long, "fr"), (2, long, "en"), (3, long, None), (4, None, "en"), (5, "", ""), (0, "", "fr"), (6, "a " * 400, "en"), (7, "# " + long, "en"),
        (8, "A" * 50 + long, "en"), (None, long, "en"), (None, long, "en"), (9, "AB $   c\x1f", "fr"), (9, "AB $   c\x1f", "fr"), (10, long + " |", "en"), (10, "x", "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (7, None, 1), (None, 1, 1), (9, 1, 0), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, part string").selectExpr("*", "1 AS mask", "'x' AS good", "'k' AS key")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part")
    found = sorted(tuple(r) for r in interactions.audit(interactions.mask_counts(d, x)).collect())
    assert found == sorted(r for part in ("", "en", "fr") for r in brute_audit(docs, labels, part))
    assert interactions.audit(interactions.mask_counts(d.limit(0), x)).collect() == []
    assert interactions.audit(interactions.mask_counts(d, x.limit(0))).filter("good_lost > 0").count() == 0


def test_polynomial():
    rng = np.random.default_rng(1)
    counts = [(m, int(rng.integers(0, 9))) for m in range(32)]
    c = interactions.polynomial(counts, 5)
    for some in range(32):
        assert interactions.corner(c, some) == sum(n for m, n in counts if m & some)
    for i in range(5):
        assert interactions.shapley(c, i) == sum(Fraction(n, m.bit_count()) for m, n in counts if m >> i & 1)
    assert sum(interactions.shapley(c, i) for i in range(5)) == interactions.corner(c, 31)


def test_audit_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.op11_filter_interactions(spark, SF)
    found = sorted(tuple(r) for r in df.collect())
    assert found == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op11_filter_interactions']})").fetchall())
    assert len(found) == 600 * len({r[0] for r in found})


def check_whitening(rows, vectors):
    """``rows`` of whiten() over (id, vector) pairs of one length, against exact sums and numpy's eigenvectors."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = {}
    for (i, _), row in zip(vectors, x):
        exact.setdefault(i, set()).add(int(((n * row - sums) ** 2).sum()))
    centred = ((n * x - sums) / n).astype(float)
    value, axis = np.linalg.eigh(centred.T @ centred / n)
    value, axis = value[::-1], axis[:, ::-1]
    kept = min(8, int((value > value[0] * 1e-13).sum()))
    assert sorted(rows.groupby("component").size().items()) == [(k + 1, n) for k in range(kept)]
    for r in rows.itertuples():
        assert r.n == n and int(r.deviation) in exact[r.vec_id]
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-6)
        assert r.identity_error < 1e-9
    for k in range(kept):
        own = np.sort((centred @ axis[:, k]) / np.sqrt(value[k]))
        got = np.sort(rows[rows.component == k + 1].whitened.to_numpy())
        assert np.allclose(own, got, atol=1e-6) or np.allclose(-own[::-1], got, atol=1e-6)


def test_whitening_query(spark):
    rows = queries.op12_embedding_whitening(spark, SF).toPandas()
    assert list(rows.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(rows, [(r.vec_id, r.embedding) for r in table if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)])
    assert rows.identity_error.nunique() == 1


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    plain = [(int(i % 50), [float(z) for z in v]) for i, v in enumerate(rng.normal(size=(90, 3)) * [1, 100, 1e-2])]
    other = [(1000 + i, [float(z) for z in v]) for i, v in enumerate(rng.normal(size=(40, 11)))]
    odd = [(1, None), (2, []), (3, [None, 1.0, 2.0]), (4, [INF, 1.0, 2.0]), (5, [float("nan"), 0.0, 0.0]), (2000, [1.0] * 5), (2001, [1.0] * 5)]
    df = spark.createDataFrame(plain + other + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "'w' AS w", "2 AS n").repartition(7)
    rows = whitening.whiten(df).toPandas()
    assert not rows.vec_id.isin([2000, 2001]).any() and not rows.identity_error.isna().any()
    check_whitening(rows[rows.vec_id < 1000], plain)
    check_whitening(rows[rows.vec_id >= 1000], other)
    for none in (df.limit(0), df.filter("vec_id >= 2000"), df.filter("vec_id = 1000")):
        assert whitening.whiten(none).collect() == []
    null_id = whitening.whiten(spark.createDataFrame([(None, [1.0]), (7, [3.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id is None, abs(r.whitened), r.explained) for r in null_id) == [(False, 1.0, 1.0), (True, 1.0, 1.0)]
    large = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation) for r in large] == [(1, None)] * 2


def test_triangles_keep_small_deviations():
    """Where one direction varies a millionth as much as another a covariance loses it; R's columns don't."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = rng.normal(size=(1000, 6)) * [1e6, 1e3, 1, 1e-3, 1e-6, 1e-7] @ turn
    r = whitening.triangle(rows[:3])
    for part in np.array_split(rows[3:], 9):
        r = whitening.triangle(np.vstack([r, part]))
    lengths, axes = whitening.jacobi(r)
    want = np.linalg.svd(rows, compute_uv=False)
    assert np.allclose(lengths[:4], want[:4], rtol=1e-8) and np.allclose(axes @ axes.T, np.eye(6), atol=1e-12)
    assert np.allclose(np.linalg.norm(r @ axes.T, axis=0), lengths, rtol=1e-6)
    met = [pair for a, b in whitening.rounds(7) for pair in map(frozenset, zip(a.tolist(), b.tolist()))]
    assert len(met) == len(set(met)) == 21
    many = whitening.squared_length(whitening.from_mean(np.array([[2**40, 5], [0, 0]]), 2, np.array([2**40, 5])))
    assert many == [None, None] and whitening.squared_length(np.array([[3, 4]], dtype=object)) == [25]
