"""Long tracks, ordered groups and part quantiles against plain code, at chunk sizes that cut everywhere."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import asof, graph, grid, groups, overlap, robust, session, track


def rows(seed, n=400):
    """Two keys, bursts, ties of time and null times."""
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), k, None if rnd.random() < 0.02 else float(rnd.choice([rnd.randrange(50), rnd.uniform(0, 5), 1000.0])), rnd.uniform(0, 9)) for k in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(1), "k string, id long, t double, v double").cache()


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_brackets_are_those_of_one_window(spark, df, size):
    probes = spark.createDataFrame(rows(2), "k string, id long, t double, v double")
    fixes = df.dropDuplicates(["k", "t"])  # equal times of fixes are told apart by order only
    for gap in (None, 3.0):
        one = {tuple(r) for r in asof.bracket(probes, fixes, ["k"], "t", ["v"], ["id"], gap).select("id", "k", "a", "b").collect()}
        many = {tuple(r) for r in track.bracket(probes, fixes, ["k"], "t", ["v"], ["id"], gap, rows=size).select("id", "k", "a", "b").collect()}
        assert one == many
    assert track.bracket(probes, fixes.limit(0), ["k"], "t", ["v"], ["id"], None, rows=size).where("a is not null or b is not null").count() == 0
    assert track.bracket(probes.limit(0), fixes, ["k"], "t", ["v"], ["id"], None, rows=size).count() == 0


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_numbers_medians_and_runs_are_those_of_one_window(df, size):
    got = {r.id: r.n for r in track.numbered(df, ["k"], "t", ["id"], "n", size).collect()}
    held = [r for r in df.collect()]
    for key in "ab":
        order = sorted((r for r in held if r.k == key), key=lambda r: (r.t is not None, r.t or 0.0, r.id))
        assert [got[r.id] for r in order] == list(range(len(order)))
    one = {r.id for r in robust.despike(df, ["k"], ["t", "id"], "v").collect()}
    assert one == {r.id for r in track.despike(df, ["k"], "t", ["id"], "v", rows=size).collect()}
    breaks = F.col("t") - F.col("prev.t") > 0.4
    one = {(r.id, r.session) for r in session.sessionise(df, ["k"], ["t", "id"], breaks).collect()}
    assert one == {(r.id, r.session) for r in track.sessionise(df, ["k"], "t", ["id"], breaks, rows=size).collect()}


def test_one_key_is_spread_over_many_chunks(spark):
    long = spark.range(100_000).select(F.lit("x").alias("k"), F.pow("id", 3).alias("t"))
    sizes = [r["count"] for r in track.chunked(long, ["k"], "t", 5000).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 10 and sum(sizes) == 100_000


def test_groups_by_a_plain_loop(spark):
    rnd = random.Random(4)
    data = [("ab"[rnd.random() < 0.3], k, rnd.choice("mn"), rnd.uniform(0, 3), rnd.uniform(0, 3), round(0.4 * k + rnd.choice([0, 0, 40]), 3)) for k in range(500)]
    df = spark.createDataFrame(data, "s string, id long, kind string, x double, y double, t double")
    got = groups.last_near(df, ["s"], "kind", "x", "y", "t", ["id"], 1.2, 3.0).collect()
    bands = groups.first_overlapping(df.withColumn("low", F.col("x")).withColumn("high", F.col("x") + 0.2), ["s"], "t", "low", "high", ["id"], 3.0).collect()
    for s in "ab":
        found, wide = [], []
        for r in sorted((r for r in data if r[0] == s), key=lambda r: (r[5], r[1])):
            near = [g for g in found[-12:] if g[-1][2] == r[2] and np.hypot(g[-1][3] - r[3], g[-1][4] - r[4]) < 1.2 and r[5] - g[-1][5] < 3]
            near[-1].append(r) if near else found.append([r])
            meet = [g for g in wide if r[5] - g[-1][5] < 3 and r[3] < max(q[3] + 0.2 for q in g) and r[3] + 0.2 > min(q[3] for q in g)]
            meet[0].append(r) if meet else wide.append([r])
        for rows_, want in ((got, found), (bands, wide)):
            held = {}
            for r in (r for r in rows_ if r.s == s):
                held.setdefault((r["_part"], r.group), set()).add(r.id)
            assert sorted(map(sorted, held.values())) == sorted(sorted(r[1] for r in g) for g in want)


@pytest.mark.parametrize("parts", [2, 64])
def test_part_quantiles_are_exact(spark, parts):
    rng = np.random.default_rng(parts)
    data = [("a", float(v)) for v in rng.integers(0, 20, 3000)] + [("b", float(v)) for v in rng.normal(0, 1, 2000)] + [("c", 5.0), ("d", None), (None, 1.0), (None, 2.0)]
    got = {r.k: r for r in robust.part_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"p0": 0.0, "p3": 0.3, "p98": 0.98, "p1": 1.0}, parts).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k in got:
        v = [x for key, x in data if key == k]
        assert [got[k][n] for n in ("p0", "p3", "p98", "p1")] == pytest.approx(np.quantile(v, [0, 0.3, 0.98, 1]).tolist())


def test_nearest_anywhere_and_rectangles_with_odd_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, None, 1.0)], "id long, x double, y double")
    probes = spark.createDataFrame([(10, 1e6, 1e6), (11, 0.1, 0.0), (11, 0.1, 0.0), (12, None, 0.0)], "p long, x double, y double")
    got = sorted((r.p, r.near.order if r.near else None) for r in asof.nearest_anywhere(probes, points, ("x", "y"), ("x", "y"), "id", 0.5).collect())
    assert got == [(10, 2), (11, 1), (11, 1), (12, None)]
    assert asof.nearest_anywhere(probes, points.limit(0), ("x", "y"), ("x", "y"), "id", 0.5).where("near is not null").count() == 0
    boxes = spark.createDataFrame([("k", 0.0, 10.0, 0.0, 1.0), ("k", 3.0, 1.0, 0.0, 9.0)], "k string, low double, high double, left double, right double")
    spots = spark.createDataFrame([("k", 0.0, 1.0), ("k", 10.0, 0.5), ("k", 10.1, 0.5), ("k", 2.0, 5.0), ("j", 1.0, 0.5), ("k", None, 0.5)], "k string, a double, b double")
    assert sorted(map(tuple, graph.outside_rectangles(spots, boxes, ["k"], "a", "b", 2.0).collect()), key=str) == [("j", 1.0, 0.5), ("k", 10.1, 0.5), ("k", 2.0, 5.0), ("k", None, 0.5)]


def test_fitting_sizes_by_a_loop(spark):
    areas = [(w, h) for w in (0.0, 3.0, 1000.0) for h in (0.5, 77.0)]
    got = spark.createDataFrame(areas, "w double, h double").select("w", "h", grid.fitting_size(F.col("w"), F.col("h"), 500, 1.0, 1.0).alias("s")).collect()
    for r in got:
        s = max(1.0, (r.w * r.h / 500) ** 0.5)
        while (np.ceil(r.w / s) + 3) * (np.ceil(r.h / s) + 3) > 500:
            s *= 1.01
        assert r.s == pytest.approx(s)


@pytest.mark.parametrize(("block", "size"), [(1, 3), (4, 50), (128, 10_000)])
def test_overlaps_by_ranks_are_those_of_all_pairs(spark, block, size):
    rnd = random.Random(block)
    points = [(rnd.choice([None, float(rnd.randrange(30)), rnd.uniform(0, 30)]), rnd.choice([None, rnd.randrange(1000)])) for _ in range(300)]
    spans = [(k, rnd.choice([None, float(rnd.randrange(-2, 33))]), rnd.choice([None, float(rnd.randrange(-2, 33)), rnd.uniform(0, 30)])) for k in range(80)] + [(99, 3.0, 3.0)]
    df = overlap.overlap_summary(spark.createDataFrame(spans, "k int, a double, b double"), spark.createDataFrame(points, "t double, v int"), "a", "b", "t", "v", block, size)
    for r in df.collect():
        inside = [v for t, v in points if None not in (t, r.a, r.b) and r.a <= t <= r.b]
        assert (r.n, r.least) == (len(inside), min((v for v in inside if v is not None), default=None))
