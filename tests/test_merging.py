"""Whole databases merged, and many patterns at once, against plain versions."""

import random
import re

import pytest

from strandline.operators import merging, patterns, vocab


def test_rings_and_references_to_itself(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {"a": df([(1, None, 5)], "k int, a int, b int"), "b": df([(5, 1, "x")], "k int, a int, note string"), "c": df([(1,)], "k int"), "d": df([(9, 1)], "k int, c int")}
    s = {
        "a": df([(1, 2, 6), (2, 1, 99), (3, 3, None), (None, 1, 1)], "k int, a int, b int"), "b": df([(6, 1), (5, 3)], "k int, a int"),  # no note
        "d": df([(1, 1)], "k int, c int"), "other": df([(1,)], "k int"),
    }
    keys = dict.fromkeys("abcd", "k")
    references = {("a", "a"): "a", ("a", "b"): "b", ("b", "a"): "a", ("d", "c"): "c"}
    merged, maps = merging.merge_database(t, s, keys, references)
    rows = lambda name: sorted(map(tuple, merged[name].collect()), key=str)
    assert rows("a") == sorted([(1, None, 5), (2, 3, 7), (3, 2, None), (4, 4, None)], key=str)
    assert rows("b") == sorted([(5, 1, "x"), (6, 4, None), (7, 2, None)], key=str)
    assert rows("c") == [(1,)] and rows("d") == [(10, None), (9, 1)] and set(maps) == {"a", "b", "d"}
    merged, _ = merging.merge_database(t, s, keys, references, lambda name, rows: None if name == "b" else rows, skip=["d"])
    assert rows("b") == [(5, 1, "x")] and rows("d") == [(9, 1)] and (2, 3, None) in rows("a")
    merged, _ = merging.merge_database(t, {"d": s["d"]}, keys, references, only=["d"], keep_keys=["d"])
    assert rows("d") == [(1, None), (9, 1)]
    with pytest.raises(ValueError, match="already"):
        merging.merge_database(t, s, keys, references, keep_keys=["a"])
    with pytest.raises(ValueError, match="without a key"):
        merging.merge_database(t, s, {"a": "k"}, references)


def test_layers():
    parents = {"line": ["order", "part"], "order": ["customer", "order"], "customer": ["nation", "order"], "x": ["customer"], "nation": [], "part": []}
    assert merging.table_layers(parents) == [["nation", "part"], ["customer", "order"], ["line", "x"]]
    assert merging.table_layers({}) == [] and merging.table_layers({"a": ["b"], "b": ["a"]}) == [["a", "b"]]


def test_pieces():
    assert patterns.pieces(r"foo.*bar\.x?y+z[abc]q(?:no)*end") == ["foo", "bar.", "y", "z", "q", "end"]
    assert patterns.pieces(r"a{0,3}b{2}c*?[]x]d\d\w+") == ["b", "d"]
    assert patterns.alternatives(r"a|b(c|d)|[|]e\|f") == ["a", "b(c|d)", r"[|]e\|f"]
    assert patterns.alternatives(r"(?:ab|(?:cd|ef))") == ["ab", "cd", "ef"] and patterns.alternatives("(a)|(b)c") == ["a", "(b)c"]


def test_first_rule_wins(spark):
    """Rules with wildcards, options, groups and classes against trying each in turn."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.randint(1, 4)))
    piece = lambda: rng.choice([word(), word(), ".*" + word(), word() + "?", "[abc]" + word(), f"(?:{word()}|{word()})", word() + r"\d*", rf"{word()}{{0,2}}", r"\."])
    rules = [("|".join("".join(piece() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))), f"r{k}") for k in range(1000)]
    texts = ["".join(rng.choice("abcdeABCDE.1\n") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    known = patterns.Rules(rules)
    compiled = [re.compile(p, re.I | re.S | re.A) for p, _ in rules]
    want = [next((i for i, c in enumerate(compiled) if c.match(t)), None) for t in texts]
    assert [known.first(t) for t in texts] == want
    assert sum(len(known.worth_trying(t)) for t in texts) < 0.6 * len(texts) * len(rules)
    rules += [("naïve café", "accents"), ("", "any")]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "Naïve Café!", "zzz"]], "label string")
    found = {r.label: r.found for r in patterns.classify(df, "label", [(p, x) for p, x in rules if p != ""], "none", "found").collect()}
    assert found[None] == "none" and all(found[t] == ("none" if w is None else f"r{w}") for t, w in zip(texts, want))
    assert patterns.classify(df.limit(0), "label", rules).collect() == []
    assert {r.found for r in patterns.classify(df.filter("label = 'zzz'"), "label", [("", "any")], label="found").collect()} == {"any"}
    with pytest.raises(ValueError):
        patterns.classify(df, "label", [("a", 1)])


def test_dependencies_in_layers(spark):
    edges = lambda rows: spark.createDataFrame(rows, "child string, parent string")
    found = vocab.dependencies_in_layers(edges([("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("e", "d"), ("x", "a"), ("d", "c"), (None, "a")]))
    assert {r.name: r.layer for r in found.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": 1}
    assert vocab.dependencies_in_layers(edges([])).collect() == []
    for ring in ([("a", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError, match="ring"):
            vocab.dependencies_in_layers(edges(ring))
