"""Ranges and as-of joins against brute force, with slices and shares of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import lookup, ordered
from strandline.operators.episodes import two_drug_episodes
from strandline.operators.ordered import as_of


@pytest.fixture
def narrow(monkeypatch):
    for name, value in dict(SLICE_CUTS=7, SHARE_ROWS=20, HOT_ROWS=30, HOT_SLICES=8, STRIDE=2).items():
        monkeypatch.setattr(ordered, name, value)


def _ranges(rng):
    out = [(rng.choice([i, None]) if i % 40 == 0 else i % 37, low := rng.randint(0, 300), low + rng.choice([-3, 0, 1, 2, 5, 40, 200]), f"L{i}") for i in range(120)]
    return [*out, (5, None, 7, "n"), (6, 3, None, "n"), (0, 10, 20, None)]


def _first(ranges, v):
    own = [(o, x is not None, x) for o, low, high, x in ranges if None not in (o, low, high, v) and low <= v < high]
    return (True, min(own)[2]) if own else (False, None)


@pytest.mark.parametrize("few", [10_000, 0])
def test_range_lookup(spark, narrow, few):
    rng = random.Random(1)
    ranges, points = _ranges(rng), [(i, rng.choice([None, 17, *range(-5, 520)])) for i in range(400)] + [(9, 17)] * 60
    r, p = spark.createDataFrame(ranges, "ordinal int, low int, high int, label string"), spark.createDataFrame(points, "row int, at int")
    met = [(i, v, *_first(ranges, v)) for i, v in points]
    for how, want in (("left", [(i, v, x) for i, v, _, x in met]), ("inner", [(i, v, x) for i, v, ok, x in met if ok]), ("semi", [(i, v) for i, v, ok, _ in met if ok])):
        assert sorted(map(tuple, lookup.range_lookup(p, "at", r, how, few).collect()), key=str) == sorted(want, key=str), how
    empty = lookup.range_lookup(p, "at", r.limit(0), few=few)
    assert empty.count() == len(points) and empty.filter("label IS NOT NULL").count() == 0
    assert lookup.range_lookup(p.limit(0), "at", r, few=few).collect() == []


def test_ranges_of_other_types(spark):
    days = spark.sql("SELECT 0 AS ordinal, DATE'2024-01-01' AS low, DATE'2024-02-01' AS high, 1.5D AS label UNION ALL SELECT 1, DATE'2024-01-15', DATE'2024-03-01', 2.5D")
    for few in (10, 0):
        asked = spark.sql("SELECT explode(array(DATE'2023-12-31', DATE'2024-01-31', DATE'2024-02-01', DATE'2024-03-01')) AS d")
        assert [r.label for r in lookup.range_lookup(asked, "d", days, few=few).orderBy("d").collect()] == [None, 1.5, 2.5, None]
        times = days.withColumns({c: F.col(c).cast("timestamp") for c in ("low", "high")})
        assert [r.label for r in lookup.range_lookup(asked.select(F.col("d").cast("timestamp").alias("d")), "d", times, few=few).orderBy("d").collect()] == [None, 1.5, 2.5, None]


def test_a_million_ranges(spark):
    """Ranges without overlaps: no nested loop, nothing broadcast but single rows, every label right."""
    ranges = spark.range(1_000_000).selectExpr("id AS ordinal", "id * 3 AS low", "id * 3 + 2 AS high", "id AS label")
    points = spark.range(0, 3_000_000, 7).withColumnRenamed("id", "v")
    found = lookup.range_lookup(points, "v", ranges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Broadcast" not in plan and "Cartesian" not in plan
    wrong = found.filter(~F.col("label").eqNullSafe(F.expr("if(v % 3 < 2, v div 3, null)")))
    assert found.count() == points.count() and wrong.count() == 0


def test_sweep_equals_pieces(spark):
    ranges = _ranges(random.Random(4))
    few = {(low, high): x for low, high, x in ordered.sweep(ranges)}
    many = {(r.low, r.high): r.label for r in ordered.pieces(spark.createDataFrame(ranges, "ordinal int, low int, high int, label string")).collect()}
    assert few == many


def _brute(left, right, direction, within, exact):
    out = []
    for i, k, t in left:
        near = []
        for j, k2, t2 in right:
            if None in (k, t, k2, t2) or k != k2 or within is not None and abs(t - t2) > within or not exact and t == t2:
                continue
            if direction == "backward" and t2 > t or direction == "forward" and t2 < t:
                continue
            near.append((abs(t - t2), t2 > t, -j, j))
        out.append((i, k, t, min(near)[3] if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_as_of(spark, narrow, direction):
    rng = random.Random(7)
    key = lambda: rng.choice([None, "a", "b", "c", *["hot"] * 6])
    left = [(i, key(), rng.choice([None, 50, *range(100)])) for i in range(300)] + [(i, "hot", 50) for i in range(900, 960)]
    right = [(j, key(), rng.choice([None, *range(100)])) for j in range(150)]
    a, b = spark.createDataFrame(left, "id int, key string, t int"), spark.createDataFrame(right, "j int, key string, t int").select("key", "t", "j")
    for within, exact in ((None, True), (3, True), (None, False)):
        found = as_of(a, b, "t", "t", ["key"], direction, None if within is None else F.lit(within), exact).selectExpr("id", "key", "t", "met.j")
        assert sorted(map(tuple, found.collect()), key=str) == _brute(left, right, direction, within, exact)
    whole = as_of(a.drop("key"), b.drop("key"), "t", "t", direction=direction).selectExpr("id", "t", "met.j")
    same = [(i, 1, t) for i, _, t in left], [(j, 1, t) for j, _, t in right]
    assert sorted(map(tuple, whole.collect()), key=str) == sorted([(i, t, j) for i, _, t, j in _brute(*same, direction, None, True)], key=str)
    assert as_of(a, b.limit(0), "t", "t", ["key"], direction).filter("met IS NOT NULL").count() == 0
    assert as_of(a.limit(0), b, "t", "t", ["key"], direction).collect() == []


def test_as_of_of_times(spark):
    a = spark.sql("SELECT 1 AS i, TIMESTAMP'2024-01-02 00:00:00' AS t UNION ALL SELECT 2, TIMESTAMP'2024-01-09 00:00:00'")
    b = spark.sql("SELECT TIMESTAMP'2024-01-01 12:00:00' AS t, 'x' AS met")
    near = as_of(a, b, "t", "t", direction="nearest", within=F.expr("INTERVAL 1 DAY"), met="found").orderBy("i").collect()
    assert [r.found and r.found.met for r in near] == ["x", None]


def test_episodes_of_one_person_with_many_mentions(spark):
    """10,000 mentions of three drugs: each B meets one candidate for each drug, not all before it."""
    rows = spark.range(10_000).selectExpr("1 AS p", "CAST(date_add(DATE'2000-01-01', CAST(id AS INT)) AS DATE) AS day", "elt(CAST(1 + (id div 40) % 3 AS INT), 'x', 'y', 'z') AS drug")
    found = two_drug_episodes(rows, "p", "drug", "day", first_only=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == len({tuple(r) for r in found.collect()}) > 5000 and "<=(d2" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_episodes_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(p, rng.choice("abc"), rng.randint(0, 120)) for p in range(25) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "p int, drug string, d int").selectExpr("p", "drug", "date_add(DATE'2020-01-01', d) AS day")
    want = []
    for p in range(25):
        own = sorted((d, x) for q, x, d in rows if q == p)
        pick = None
        for at in range(1, len(own) if len(own) >= 4 else 0):
            b1, b = own[at]
            b2 = [d for d, x in own if x == b and d >= b1 + 27]
            others = [(d, x) for d, x in own if x != b and d <= b1]
            for a1, a in own[: len(others) - 1] if b2 and len(others) >= 2 else []:
                a2 = [d for d, x in own if x == a and d >= a1 + 27]
                if a == b or a1 + 27 > b1 or not a2 or any(x == b and a1 <= d < a2[0] for d, x in own):
                    continue
                pick = pick or (p, a, a1, a2[0], b, b1, b2[0])
        want += [pick] if pick else []
    day = lambda c: (F.datediff(c, F.lit("2020-01-01").cast("date"))).alias(c)
    got = two_drug_episodes(df, "p", "drug", "day").select("patient_id", "drug_a_name", day("drug_a_first"), day("drug_a_second"), "drug_b_name", day("drug_b_first"), day("drug_b_second"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want




def test_small_tables_are_known_by_their_plan(spark):
    """No job for a small file; a table that may grow is counted; a large one isn't broadcast."""
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planned", "lookup.small")
    hinted = lookup.small(nation.filter("n_nationkey > 3").select("n_name"))
    assert not tracker.getJobIdsForGroup("planned")
    lookup.small(nation.select(F.explode(F.array("n_name", "n_name")).alias("n_name")))
    assert tracker.getJobIdsForGroup("planned")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    large = lookup.small(spark.range(20_000).toDF("k"))
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()


def test_ranges_that_cover_many_ends_are_not_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_CUTS", 200)
    handed, handed_down = [], ordered._handed_down
    monkeypatch.setattr(ordered, "_handed_down", lambda blocks, levels: handed.append(blocks.count()) or handed_down(blocks, levels))
    rng = random.Random(7)
    ranges = [(rng.randint(0, 900), low := float(rng.randint(0, 10**6)), low + rng.choice([9, 20_000, 150_000]), f"L{i}") for i in range(1000)]
    nan = float("nan")
    ranges += [(950, 2e6, nan, "to NaN"), (951, 1.5e6, float("inf"), "to infinity")]
    found = ordered.pieces(spark.createDataFrame(ranges, "ordinal long, low double, high double, label string")).orderBy("low").collect()
    assert sum(handed) < 250  # of a few slices; a thousand ranges were some 4,000 blocks
    key = lambda x: (x != x, 0.0 if x != x else x)  # noqa: E731  NaN is the largest
    held = [(o, key(a), key(b), x) for o, a, b, x in ranges]
    for r in found:
        assert r.label == min((o, x) for o, a, b, x in held if a <= key(r.low) < b)[1]
    ends = {a for _, a, _, _ in held} | {b for _, _, b, _ in held}
    assert {key(r.low) for r in found} == {e for e in ends if any(a <= e < b for _, a, b, _ in held)}
    after = sorted(ends)
    assert all(key(r.high) == after[after.index(key(r.low)) + 1] for r in found)
