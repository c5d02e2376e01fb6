"""Ping budgets, relief ranges, candidates on view and on the map, and names of files."""

import math
import random

from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import asof, grid, sample
from fathom.plans import cracks


def test_budget_takes_the_least_step(spark):
    rows = [(k, i) for k, n in (("a", 1), ("b", 10), ("c", 11), ("d", 25)) for i in range(n)]
    got = sample.within_budget(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], 10).collect()
    by = {k: sorted(r.i for r in got if r.k == k) for k in "abcd"}
    assert by == {"a": [0], "b": list(range(10)), "c": list(range(0, 11, 2)), "d": list(range(0, 25, 3))}
    assert sample.within_budget(spark.createDataFrame([], "k string, i int"), ["k"], ["i"], 10).count() == 0


def test_relief_range_equals_a_plain_walk(spark):
    rnd = random.Random(5)
    cells = [(s, i, j, rnd.choice([-1.0, rnd.uniform(0, 3), None]), rnd.choice([rnd.uniform(0, 3), None])) for s in "ab" for i in range(-7, 9) for j in range(3, 14) if rnd.random() < 0.7]
    cells.append(("flat", 0, 0, 1.0, 1.0))
    cells.append(("none", 0, 0, None, 1.0))
    got = {r.s: r.range for r in grid.relief_range(spark.createDataFrame(cells, "s string, i int, j int, d double, b double"), ["s"], "d", "b").collect()}
    want = {}
    for s in ("a", "b", "flat", "none"):
        own = {(i, j): (d, b) for t, i, j, d, b in cells if t == s}
        i0, i1, j0, j1 = min(i for i, _ in own), max(i for i, _ in own), min(j for _, j in own), max(j for _, j in own)
        walk = [own.get((i, j)) for j in range(j0, j1 + 1) for i in range(i0, i1 + 1)][::3]
        off = sorted(abs(c[1] - c[0]) for c in walk if c and c[0] is not None and c[1] is not None and c[0] >= 0 and c[1] >= 0)
        want[s] = max(0.1, off[min(len(off) - 1, math.floor(len(off) * 0.98))] if off else 0.1)
    assert got == want


def test_candidates_on_view(spark):
    df = spark.createDataFrame([(1, "high"), (2, "low"), (3, "low"), (4, None)], "id int, confidence string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(cracks.shown(df)) == [1, 4]
    assert ids(cracks.shown(df, chosen=[3])) == [1, 3, 4]
    assert ids(cracks.shown(df, low=True)) == [1, 2, 3, 4]


def test_ends_hang_on_the_nearest_ping(spark):
    """Of two pings as near the earlier one; over gaps of any width; null in a survey without pings."""
    pings = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 2.0, 2.0), ("s", 3, 100.0, 100.0)], "survey string, ping long, along double, x double")
    pings = pings.select("*", F.lit(0.0).alias("y"), F.lit(1.0).alias("hx"), F.lit(0.0).alias("hy"), F.lit(0.0).alias("lon0"), F.lit(0.0).alias("lat0"))
    found = spark.createDataFrame([("s", 7, 3.0, 1.0, -2.0, 60.0), ("lone", 8, 0.0, 0.0, 0.0, 0.0)], "survey string, id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.lonlat for r in cracks.placed(found, pings).collect()}
    metres = [[round(v * 111_320, 6) for v in end] for end in got[7]]
    assert metres == [[0.0, 3.0], [100.0, -2.0]] and got[8] is None


def test_names(spark):
    rows = [("Lake a/b.SL3", 5, 3725.4, -1.5, 52.25), ("x.sl3", 2, -3.0, None, None), ("pic", None, 59.5, 0.0, -0.00001), (None, 5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "name string, channel int, s double, lon double, lat double")
    got = [r[0] for r in df.select(text.picture_name(F.col("name"), F.col("channel"), F.col("s"), F.col("lon"), F.col("lat"))).collect()]
    assert got == ["Lake_a_b_sidescan_1h02m05s_52.25000N_1.50000W.png", "x_downscan_0h00m00s.png", "pic_0h01m00s_0.00001S_0.00000E.png", None]
    assert df.select(text.route_name(F.col("name"), "gpx")).first()[0] == "Lake_a_b_route.gpx"


def test_a_fix_at_the_probes_own_time_is_nearest(spark):
    probes = spark.createDataFrame([("k", 5.0), ("k", 6.5)], "k string, t double")
    fixes = spark.createDataFrame([("k", 4.0, 1), ("k", 5.0, 3), ("k", 5.0, 2), ("k", 8.0, 4)], "k string, t double, id int")
    got = {r.t: r.near.id for r in asof.nearest_in_time(probes, fixes, ["k"], "t", ["id"], ["id"]).collect()}
    assert got == {5.0: 2, 6.5: 2}
