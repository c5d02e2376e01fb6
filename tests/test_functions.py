"""Closed forms against values worked out by hand, and operators against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathom.functions import geo, text
from fathom.operators import arrays, asof, graph, grid, robust, sample
from fathom.plans import export


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_closed_forms(spark):
    L = F.lit
    r = one(
        spark,
        geo.mercator_lon(L(1_000_000.0)),
        geo.mercator_lat(L(5_000_000.0)),
        geo.distance_m(L(10.0), L(50.0), L(10.001), L(50.001)),
        geo.gps_week(L(2300 * 604_800 + 123_456.789)),
        geo.gps_week_ms(L(2300 * 604_800 + 123_456.789)),
        geo.gps_to_utc_text(L(2300 * 604_800 + 123_456.789)),
    )
    assert r.c0 == pytest.approx(9.013372974292617) and r.c1 == pytest.approx(41.030357698339486) and r.c2 == pytest.approx(132.33396059727832)
    assert (r.c3, r.c4, r.c5) == (2300, 123_456_789, "2024-02-05T10:17:18.789Z")


@pytest.mark.parametrize(
    ("r", "toe", "end", "want"),
    [(5.0, None, 10.0, 4.0), (2.9, None, 10.0, None), (11.0, None, 10.0, None), (4.5, 4.0, 7.0, 3.3541019662496847), (6.0, 4.0, 7.0, 5.924816605476077), (7.5, 4.0, 7.0, None)],
)
def test_ground_range(spark, r, toe, end, want):
    got = one(spark, geo.ground_range(F.lit(r), F.lit(3.0), F.lit(0.2), F.lit(toe).cast("double"), F.lit(end))).c0
    assert got == (None if want is None else pytest.approx(want))


def test_shadow_height(spark):
    y, h = geo.shadow_height(F.lit(3.0), F.lit(5.0), F.lit(6.0))
    r = one(spark, y, h)
    assert r.c0 == pytest.approx(4.479118216792229) and r.c1 == pytest.approx(0.7604408916038854)


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    r = df.agg(robust.quantile("x", 0.9).alias("a"), robust.quantile("x", 0.5).alias("b"), robust.upper_median("x").alias("c")).first()
    assert (r.a, r.b, r.c) == (pytest.approx(6.8), 3, 4)
    levels = spark.createDataFrame([(0, float(x)) for x in (10, 20, 30, 40, 50)], "k int, x double")
    assert [robust.histogram_quantile(levels, ["k"], "x", q).first().level for q in (0.05, 0.5, 0.6)] == [10, 30, 40]


def test_text(spark):
    r = one(spark, text.number_text(F.lit(1e7)), text.number_text(F.lit(1.0)), text.number_text(F.lit(0.125)), text.number_text(F.lit(float("nan"))), text.xml_text(F.lit("<a & 'b'>")), text.file_stem(F.lit("my lake (1).SL3")), text.duration_text(F.lit(125.4)))
    assert tuple(r) == ("10000000", "1", "0.125", "", "&lt;a &amp; &#39;b&#39;&gt;", "my_lake_1_", "2:05")


def test_valid_position(spark):
    cases = [(0.0, 0.0, False), (0.0, 1.0, True), (181.0, 0.0, False), (float("nan"), 1.0, False), (None, 1.0, False), (10.0, -90.0, True)]
    df = spark.createDataFrame(cases, "lon double, lat double, want boolean")
    assert all(r.got == r.want for r in df.select(geo.valid_position(F.col("lon"), F.col("lat")).alias("got"), "want").collect())


def test_bracket_by_hand(spark):
    fixes = spark.createDataFrame([("k", 0.0, 0.0, 0), ("k", 1.0, 10.0, 1), ("k", 4.0, 40.0, 2)], "k string, t double, v double, o int")
    probes = spark.createDataFrame([("k", t) for t in (0.0, 0.5, 1.0, 2.0, 4.0, 5.0, -1.0)], "k string, t double")
    got = {r.t: r.at_v for r in asof.interpolate(probes, fixes, ["k"], "t", ["v"], ["o"], 2.0).collect()}
    assert got == {0.0: 0, 0.5: 5, 1.0: 10, 2.0: None, 4.0: None, 5.0: None, -1.0: None}


def test_bracket_against_binary_search(spark):
    rnd = random.Random(5)
    fixes, probes, want = [], [], {}
    for k in range(60):
        times = sorted(rnd.choice(range(12)) / 2 for _ in range(rnd.randrange(6)))
        vals = [rnd.random() for _ in times]
        fixes += [(k, t, v, o) for o, (t, v) in enumerate(zip(times, vals))]
        for p in range(8):
            x = rnd.choice(range(-1, 14)) / 2
            probes.append((k, p, x))
            out = None
            if len(times) >= 2 and times[0] <= x <= times[-1]:
                i = max(1, min(len(times) - 1, next(i for i, t in enumerate(times) if t >= x)))
                gap = times[i] - times[i - 1]
                if 0 < gap <= 2:
                    out = vals[i - 1] + (vals[i] - vals[i - 1]) * (x - times[i - 1]) / gap
            want[k, p] = out
    f = spark.createDataFrame(fixes, "k int, t double, v double, o int")
    p = spark.createDataFrame(probes, "k int, p int, t double")
    got = {(r.k, r.p): r.at_v for r in asof.interpolate(p, f, ["k"], "t", ["v"], ["o"], 2.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in want)


def test_idw_by_hand(spark):
    def fill(points, radius=2.0):
        cells = spark.createDataFrame(points, "i bigint, j bigint, value double")
        return {(r.i, r.j): r.value for r in grid.idw_fill(cells, 1.0, radius).collect()}

    assert fill([(1, 0, 2.0), (-1, 1, 4.0), (-1, -1, 6.0)])[0, 0] == pytest.approx(3.5)
    assert (0, 0) not in fill([(1, 0, 2.0), (0, 1, 4.0), (-1, 0, 6.0)])
    assert (0, 0) not in fill([(1, 0, 2.0), (0, 1, 4.0)])


def test_components_and_merging(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 100)], "a int, b int")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 1.2, 0.02, 2.0, 0.02, 0.0), (3, 1.1, 0.0, 1.1, 1.0, 90.0), (4, 5.0, 5.0, 6.0, 5.0, 0.0)], "id int, x1 double, y1 double, x2 double, y2 double, angle double")
    assert {r.id: r.root for r in graph.merge_lines(lines, 0.5, 0.08).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_stamp_and_samples(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.0, 0.5), (2, 0.0, 0.0, 0.5, 0.5, 0.0, 0.25)], "id int, x double, y double, half_length double, half_width double, heading double, height double")
    cells = {(r.i, r.j): (r.raised, r.id) for r in grid.stamp(o, 0.5).collect()}
    assert cells[0, 0] == (0.75, 2) and cells[1, 0] == (0.5, 1) and (2, 0) not in cells and (1, 1) in cells
    df = spark.range(1000).withColumn("k", F.lit(0))
    assert [r.id for r in sample.even_sample(df, ["k"], ["id"], 7).orderBy("id").collect()] == [math.floor(i * 999 / 6) for i in range(7)]
    s = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)])
    port, starboard = arrays.split_halves(s)
    r = one(spark, port, starboard, arrays.smooth(s, 1), arrays.resample(s, 3))
    assert (r.c0, r.c1, r.c2, r.c3) == ([2, 1], [3, 4], [1.5, 2, 3, 4, 4.5], [1, 3, 5])


def test_order_of_rows_does_not_matter(spark):
    base = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("v"))
    a, b = (sorted(map(tuple, robust.despike(d, ["k"], ["o"], "v").collect())) for d in (base.repartition(1), base.repartition(13, "v")))
    assert a == b


def test_repeated_probes_come_back(spark):
    from fathom.operators import asof, grid

    probes = spark.createDataFrame([(1, 0.2, 0.3), (1, 0.2, 0.3), (2, 5.0, 5.0)], "id int, x double, y double")
    points = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.3, 0.3)], "p int, x double, y double")
    got = asof.nearest_point(probes, points, ("x", "y"), ("x", "y"), "p", 0.5, 1).collect()
    assert sorted((r.id, r.near and r.near.order) for r in got) == [(1, 8), (1, 8), (2, None)]
    cells = spark.createDataFrame([(0, 0, 3.0)], "i long, j long, value double")
    assert sorted((r.id, r.sampled) for r in grid.bilinear(probes, cells, "x", "y", 1.0).collect()) == [(1, 3.0), (1, 3.0), (2, None)]


def test_farthest_points_against_a_plain_loop(spark):
    import math
    import random

    from fathom.operators import sample

    rnd = random.Random(6)
    rows = [("a" if i % 3 else "b", i * 11, rnd.random(), rnd.random()) for i in range(120)]
    got = {(r.k, r.t) for r in sample.farthest_points(spark.createDataFrame(rows, "k string, t long, x double, y double"), ["k"], "x", "y", "t").collect()}
    want = set()
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        taken = [own[0]]
        while len(taken) < 8 and (free := [r for r in own if all(abs(r[1] - c[1]) >= 30 for c in taken)]):
            taken.append(max(free, key=lambda r: min(math.dist(r[2:], c[2:]) for c in taken)))
        want |= {(key, r[1]) for r in taken}
    assert got == want


def test_stretches_of_a_route_against_a_plain_walk(spark):
    import random

    from pyspark.sql import functions as F

    from fathom.operators import session

    rnd = random.Random(8)
    rows, want = [], {}
    for key in range(12):
        t, x, y, own = 0.0, 0.0, 0.0, []
        for i in range(rnd.choice([2, 30, 200])):
            t += rnd.random() + 0.1
            x, y = x + rnd.uniform(-1, 4), y + rnd.uniform(-2, 2)
            own.append((key, t, x, y))
        rows += own
        along, last, base = [0.0], own[0], 0.0
        for p in own[1:]:
            d = math.hypot(p[2] - last[2], p[3] - last[3])
            if d >= 3:
                base, last, d = base + d, p, 0.0
            along.append(max(along[-1], base + d))
        k = min(range(len(own)), key=lambda i: abs(own[i][1] - 20))
        low, high = along[k] - 30, along[k] + 30
        if low < 0:
            low, high = 0.0, min(along[-1], high - low)
        if high > along[-1]:
            low, high = max(0.0, low - (high - along[-1])), along[-1]

        def at(d):
            i = next((i for i in range(1, len(own)) if along[i] >= d), len(own) - 1)
            f = min(1, max(0, (d - along[i - 1]) / max(1e-9, along[i] - along[i - 1])))
            return own[i - 1][1] + (own[i][1] - own[i - 1][1]) * f

        want[key] = (at(low), at(high), high - low)
    placed = session.route_distance(spark.createDataFrame(rows, "k int, t double, x double, y double"), ["k"], ["t"], "x", "y")
    got = {r.k: (r.start, r.end, r.length) for r in session.stretch(placed, ["k"], "t", "along", 60.0, F.lit(20.0)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_file_roles_and_line_labels(spark):
    from pyspark.sql import functions as F

    from fathom.functions import text

    df = spark.createDataFrame([("a.SL3", "open crack, 3 cm", "along"), ("b.bin", "line", "along"), ("c.txt", "line", "across")], "f string, d string, r string")
    assert [tuple(r) for r in df.select(text.file_role(F.col("f")), text.line_label(F.col("d"), F.col("r"))).collect()] == [("sonar", "Open crack"), ("log", "Crack or step down"), (None, "Crack")]


def test_preview_picks_pings_and_samples_evenly(spark):
    rows = [("s", n, n * 1000, 5, 4 if n != 2 else 1, bytes([n, 10 + n, 20 + n, 30 + n]) if n != 2 else b"\x09") for n in range(9)]
    frames = spark.createDataFrame(rows + [("s", 99, 500, 0, 4, b"abcd")], "survey string, offset long, time_ms long, channel int, ping_size int, samples binary")
    got = {(r.x, r.y): r.value for r in export.preview(frames, 5, 1.0, 6.0, columns=3, rows=2).collect()}
    # Pings 1, 3, 4, 5, 6 are in the window with samples; the first, third and fifth are shown.
    assert got == {(0, 0): 1, (0, 1): 31, (1, 0): 4, (1, 1): 34, (2, 0): 6, (2, 1): 36}
