"""A dark line in a speckled lining is the one candidate."""

import json

import numpy as np
import pandas as pd
import pytest

from fathom.plans import cracks
from fathom.plans import survey as read

N, RANGE, H = 900, 9.0, 1.5


def lining(spark, line):
    """Pings every 5 cm over 8 m of track, open to both sides; line(along, y) darkens the starboard side."""
    rng = np.random.default_rng(4)
    r = (np.arange(N) + 0.5) * RANGE / N
    y = np.sqrt(np.maximum(0, r * r - H * H))
    rows = []
    for n in range(160):
        along = n * 0.05
        port, starboard = (np.where(r > H, 120 * rng.gamma(60, 1 / 60, N), 5) for _ in range(2))
        starboard = np.where(line(along, y) & (r > H), starboard * 0.45, starboard)
        s = np.clip(np.concatenate([port[::-1], starboard]), 0, 255).astype(np.uint8)
        rows.append(("s", n, along, H, RANGE, bytes(s), 0.0, along, 0.0, 1.0, 10.0, 50.0))
    pings = spark.createDataFrame(rows, "survey string, ping long, along double, height double, range_m double, samples binary, x double, y double, hx double, hy double, lon0 double, lat0 double").cache()
    sides = read.outlines(pings).cache()
    settled = read.smooth_banks(sides.drop("row").selectExpr("*", "cast(null as double) as toe", "false as assumed"))
    spans = spark.createDataFrame([], "survey string, side int, low double, high double, left double, right double")
    return pings, settled, read.references(sides), spans


def test_one_crack(spark):
    data = lining(spark, lambda along, y: (np.abs(y - 3.0) < 0.02) & (3.0 <= along <= 4.8))
    found = cracks.placed(cracks.screen(*data), data[0]).cache()
    sure = [c for c in found.collect() if c.confidence in ("high", "medium")]
    assert len(sure) == 1
    c = sure[0]
    assert (c.kind, c.polarity, c.direction, c.side, c.id) == ("crack", "dark", "along", "starboard", 1)
    # A dark strip of 4 cm, without a lit face: what throws it is H * w / (range + w) high.
    assert c.detail.startswith("crack, or a step down") and 0.02 < c.width_m < 0.08 and c.size_cm == pytest.approx(100 * H * c.width_m / (3.0 + c.width_m), abs=0.2)
    assert abs(c.offset_m - 3.0) < 0.1 and abs(c.along_m - 3.9) < 0.3 and 1.4 < c.length_m < 2.3 and len(c.lonlat) == 2
    shape = json.loads(cracks.candidates_geojson(found).first().geojson)
    assert shape["features"][0]["properties"]["kind"] == "crack"


def test_joints_are_evenly_spaced_runs():
    at = [0.0, 5.0, 10.1, 14.9, 20.0, 33.0, 33.5, 60.0]
    got = cracks._joints(pd.DataFrame({"survey": "s", "segment": range(len(at)), "cy": at}))
    assert sorted(got["segment"]) == [0, 1, 2, 3, 4] and got["joint_spacing_m"].tolist() == pytest.approx([5.0] * 5)
    assert cracks._joints(pd.DataFrame({"survey": "s", "segment": range(3), "cy": [1.0, 1.0, 1.0]})).empty


def test_lines_that_follow_the_boat(spark):
    weave = [float(0.3 * np.sin(j / 5)) for j in range(40)]
    rows = [("s", j, j * 0.05 + 0.01, side, False, False, 8.0 + (weave[j] if side == 0 else -weave[j])) for j in range(40) for side in (0, 1)]
    sides = spark.createDataFrame(rows, "survey string, ping long, along double, side int, empty boolean, open boolean, waterline double")
    lines = {1: lambda j: 3.0 + weave[j], 2: lambda j: 3.0, 3: lambda j: -2.0 + weave[j]}
    points = [("s", k, j, float(f(j))) for k, f in lines.items() for j in range(40)] + [("s", 4, j, 1.0) for j in range(9)]
    points = spark.createDataFrame(points, "survey string, segment long, j long, x double")
    # The second keeps its distance; the fourth is too short to tell.
    assert [r.segment for r in cracks.following_boat(points, sides, 0.05).collect()] == [2]
    assert cracks.following_boat(points, sides.where("side = 0"), 0.05).count() == 0


def test_compact_objects_are_rectangles(spark):
    rows = [("s", 0, n, "object", 10 + 0.1 * n, 5.0, 0.4, 1.0) for n in range(6)]  # half a metre of track: an object
    rows += [("s", 0, 100 + n, "object", 30 + 0.2 * n, 5.0, None, 1.0) for n in range(40)]  # eight metres: perhaps a line
    rows += [("s", 1, 200 + n, "depression", 10 + 0.1 * n, 3.0, 1.0, 1.0) for n in range(2)]  # too few
    found = spark.createDataFrame(rows, "survey string, side int, id long, kind string, along double, offset double, lit double, shadow double")
    got = cracks.compact_spans(found).collect()
    assert len(got) == 1
    assert tuple(got[0])[:2] == ("s", 0) and tuple(got[0])[2:] == pytest.approx((9.7, 10.8, 4.0, 6.3))


def test_objects_are_left_out_of_the_screening(spark):
    pings, sides, reference, spans = lining(spark, lambda along, y: (np.abs(y - 3.0) < 0.02) & (3.0 <= along <= 4.8))
    box = spark.createDataFrame([("s", 1, 2.0, 6.0, 2.5, 3.5)], spans.schema)
    assert [c for c in cracks.screen(pings, sides, reference, box).collect() if c.confidence in ("high", "medium")] == []


@pytest.mark.parametrize(
    ("polarity", "direction", "lit", "kind", "detail", "sized"),
    [
        ("dark", "along", (), "crack", "crack, or a step down", True),
        ("dark", "along", (2, 3), "crack", "open crack", True),
        ("dark", "along", (-3, -2), "step", "raised edge", True),
        ("bright", "along", (), "step", "step up facing", False),
        ("dark", "across", (), "crack", "dark line", False),
        ("bright", "across", (), "edge", "lit edge", False),
    ],
)
def test_lines_are_described_by_their_profile(spark, polarity, direction, lit, kind, detail, sized):
    profile = {m: 0.4 if m in (0, 1) else 1.3 if m in lit else 1.0 for m in range(-8, 9)}
    named = spark.createDataFrame([("s", 1, polarity, direction, 5.0)], "survey string, segment long, polarity string, direction string, cx double")
    seen = spark.createDataFrame([("s", 1, 2.0, profile)], "survey string, segment long, water double, profile map<int,double>")
    got = cracks.described(named, seen).first()
    assert got.kind == kind and got.detail.startswith(detail)
    if sized:
        assert got.width_m == pytest.approx(2 * 0.015) and got.size_cm == pytest.approx(round(100 * 2.0 * 0.03 / 5.03, 1))
    else:
        assert got.size_cm is None
