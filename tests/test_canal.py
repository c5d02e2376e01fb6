"""Cross-sections, objects and lining lines on synthetic side-scan recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import lines, section
from fathom.plans import align, canal
from fathom.plans import survey as read
from fathom.sources import synthetic

LON, LAT = 10.0, 50.0
KX = 111_320 * math.cos(math.radians(LAT))
RANGE, N, H, DRAFT = 20.0, 800, 3.0, 0.2


def echoes(rng, toe=None, end=None, box=None):
    """One side: water, bed, bank to the waterline, noise; a box (start, height) throws a shadow."""
    r = (np.arange(N) + 0.5) * RANGE / N
    y = np.sqrt(np.maximum(0, r * r - H * H))
    s = np.where(r > H, 120.0, 8.0)
    if end is not None:
        s = np.where((y > toe) & (r > H), 170.0, s)
        s = np.where(r > math.hypot(end, DRAFT), 6.0, s)
    if box is not None:
        start, width, height = box
        top = start + width
        shadow = top * H / (H - height)
        s = np.where((y > start) & (y <= top), 220.0, s)
        s = np.where((r > math.hypot(top, H - height)) & (y < shadow), 8.0, s)
    return np.clip(s + rng.normal(0, 2, N), 0, 255).astype(np.uint8)


def canal_file(seconds=40, rate=5, boxed=lambda x: False):
    rng = np.random.default_rng(0)
    pings = []
    for n in range(seconds * rate):
        t = n / rate
        x = 1.0 * t
        base = {"time_ms": round(t * 1000), "lon": LON + x / KX, "lat": LAT, "depth_m": H, "max_range_m": RANGE}
        port = echoes(rng, 6.0, 9.0)
        starboard = echoes(rng, 6.0, 9.0, (3.0, 0.4, 0.5) if boxed(x) else None)
        pings.append(dict(base, channel=0))
        pings.append(dict(base, time_ms=base["time_ms"] + 50, channel=5, samples=bytes(port[::-1]) + bytes(starboard)))
    return synthetic.sonar_file(pings)


def side_of(spark, samples, reference=(), stop=None):
    row = [([float(x) for x in samples], RANGE, H, [float(x) for x in reference])]
    df = spark.createDataFrame(row, "echo array<double>, range_m double, height double, reference array<double>")
    out = section.toe(section.shadows(section.outline(df, DRAFT), 0.5), DRAFT)
    return section.relief(out, F.lit(stop) if stop is not None else F.col("n")).first()


def test_a_closed_side(spark):
    rng = np.random.default_rng(1)
    samples = echoes(rng, 6.0, 9.0)
    out = side_of(spark, samples)
    assert not out.open and out.waterline == pytest.approx(9.0, abs=0.4)
    assert out.toe == pytest.approx(6.0, abs=0.4) and not out.assumed and out.features == [] and out.relief is None
    row = np.array(out.row)
    relief = side_of(spark, samples, np.where(row > 0, row - 1.0, 0.0), round(math.hypot(5.5, H) / (RANGE / N))).relief
    assert relief is not None and np.abs(relief).max() < 0.3


def test_an_open_side_with_a_box(spark):
    rng = np.random.default_rng(2)
    out = side_of(spark, echoes(rng, box=(3.0, 0.4, 0.5)), np.full(math.ceil(RANGE / section.REFERENCE_STEP), 120.0))
    assert out.open and out.reach == pytest.approx(math.sqrt(RANGE**2 - H**2))
    assert [f["kind"] for f in out.features] == ["object"]
    assert out.features[0]["height"] == pytest.approx(0.5, abs=0.12) and out.features[0]["end"] == pytest.approx(3.4, abs=0.25)


def test_silence_is_empty(spark):
    assert side_of(spark, np.full(N, 7)).empty


def test_short_and_missing_samples(spark):
    for n in (1, 2, 7, 40):
        assert side_of(spark, np.arange(n) * 6 % 200).n == n


def test_readings_by_plain_code(spark):
    """Levels, waterline, reference row and split against loops over the samples."""
    rng = np.random.default_rng(4)
    samples = echoes(rng, 6.0, 9.0).astype(float)
    out = side_of(spark, samples)
    s = [samples[max(0, i - 2) : i + 3].mean() for i in range(N)]
    assert out.s == pytest.approx(s)
    dr, first = RANGE / N, int(H / (RANGE / N))

    def level(x, q):
        y = sorted(min(255, max(0, math.floor(v + 0.5))) for v in x)
        return y[min(len(y) - 1, int(q * len(y)))]

    assert out.noise == min(level(s[1 : first - 1], 0.5), level(s, 0.05)) and out.bed == level(s[first + 2 : int(math.hypot(2, H) / dr)], 0.5)
    mean = lambda a, b: sum(s[a:b]) / len(s[a:b])
    limit, w = out.noise + 0.2 * (out.bed - out.noise), round(0.5 / dr)
    end = next(i for i in range(first + w, N - w, w // 8) if mean(i, i + w) < limit and mean(i, min(N, i + round(3 / dr))) < limit and mean(i, N) < limit)
    assert out.end == end and out.waterline == pytest.approx(math.sqrt((end * dr) ** 2 - DRAFT**2))
    cells = {}
    for i in range(first, end):
        cells.setdefault(int(round(i * dr / 0.05, 9)), []).append(s[i])
    row = [min(255, math.floor(sum(cells[c]) / len(cells[c]) + 0.5) + 1) if c in cells else 0 for c in range(400)]
    assert all(abs(a - b) <= (b > 0) for a, b in zip(out.row, row, strict=True)) and sum(a != b for a, b in zip(out.row, row)) < 20  # a mean may lie at a half
    points = [(y, s[int(math.hypot(y, H) / dr)]) for y in (H + 0.05 + 0.1 * k for k in range(300)) if y < out.waterline and int(math.hypot(y, H) / dr) < end]

    def error(p):
        x, y = np.array(p).T
        return float(((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum())

    splits = [(error(points[: i + 1]) + error(points[i + 1 :]), i) for i in range(2, len(points) - 3) if points[i][0] - points[0][0] >= 0.4 and points[-1][0] - points[i][0] >= 0.4]
    assert out.toe == pytest.approx((points[min(splits)[1]][0] + points[min(splits)[1] + 1][0]) / 2, abs=1e-6)


def test_a_line_in_speckle_is_a_ridge():
    rng = np.random.default_rng(3)
    image = rng.normal(1, 0.1, (60, 400))
    image[30, 100:250] -= 0.5
    found = [r for r in lines.ridges(image, 0.015, 0.05, 4.5) if r[0] == "dark"]
    on = [r for r in found if r[2] == 30 and 100 <= r[1] < 250]
    assert len(on) > 100 and {r[4] for r in on} <= {0, 1, 11}


def test_canal_with_a_box(spark, tmp_path):
    (tmp_path / "c.sl3").write_bytes(canal_file(boxed=lambda x: 19.0 <= x <= 20.2))
    fixes = [{"t": 2300 * 604_800 + 500 + n / 5, "lon": LON + n / 5 / KX, "lat": LAT} for n in range(-50, 260)]
    (tmp_path / "c.bin").write_bytes(synthetic.log_file(fixes))
    frames = align.survey_key(spark.read.format("sl3").option("samples", "true").load(str(tmp_path))).cache()
    track = align.combine_fixes(spark.read.format("bin_log").load(str(tmp_path))).cache()
    sync = align.find_alignment(frames, track).cache()
    model = canal.canal_model(frames, track, sync, cell=0.4, fill_passes=1)
    banks = canal.bank_summary(model.sides).orderBy("side").collect()
    assert len(banks) == 2 and all(b.waterline == pytest.approx(9.0, abs=0.4) and b.toe == pytest.approx(6.0, abs=0.6) for b in banks)
    objects = canal.located(model.objects, model.pings).collect()
    assert len(objects) == 1
    o = objects[0]
    assert (o.kind, o.side) == ("raised", "starboard") and o.height == pytest.approx(0.5, abs=0.15) and o.along_m == pytest.approx(18.0, abs=3.5)
    kinds = {r.source: r.n for r in model.cells.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert {"measured", "bed", "bank", "land", "object"} <= kinds.keys()
    bed = model.cells.where("source = 'measured'").agg(F.avg("depth").alias("d")).first().d
    assert bed == pytest.approx(H + DRAFT, abs=0.1)
    mosaic = canal.mosaic(model.pings, model.sides, 0.5).cache()
    texels = mosaic.agg(F.count("*").alias("n"), F.max("value").alias("v")).first()
    assert texels.n > 500 and 100 < texels.v <= 255
    shown = canal.picture(mosaic, 0.5).collect()
    assert len(shown) >= texels.n and {r.level for r in shown} <= set(range(256)) and max(r.level for r in shown) == 255
    # The box throws its shadow to starboard, some 3.4 to 4.1 m off the track.
    dark = [r for r in shown if r.shadow]
    assert dark and all(-5 <= r.b * 0.5 <= -3 for r in dark)
    at = [p.t for p in model.pings.orderBy(F.abs(F.col("along") - o.along_m)).limit(1).collect()] + [1e6]
    found = canal.sections(model, spark.createDataFrame([(model.pings.first().survey, t) for t in at], "survey string, t double")).cache()
    rows = found.orderBy(F.desc("o")).collect()
    assert {r.t for r in rows} == {at[0]}
    assert rows[0].o == pytest.approx(10.5, abs=0.5) and rows[-1].o == pytest.approx(-10.5, abs=0.6)
    middle = [r.depth for r in rows if 1 < r.o < 4]
    assert middle and all(d == pytest.approx(H + DRAFT, abs=0.3) for d in middle)
    assert [(r.id, r.o < 0) for r in canal.crossing(found, model.objects).collect()] == [(o.id, True)]


def test_gaps_in_the_track_are_blended(spark):
    pings = spark.createDataFrame([("s", k, t, x, 0.0, 1.0, 0.0, d, 0.0) for k, (t, x, d) in enumerate([(0.0, 0.0, 2.0), (1.0, 1.5, 3.0), (2.0, 6.0, 4.0), (9.0, 7.0, 4.0)])], "survey string, ping long, t double, x double, y double, hx double, hy double, baseline double, anomaly double")
    sides = pings.selectExpr("survey", "ping", "explode(array(0, 1)) as side", "false as empty", "true as open", "3.0D as reach", "cast(null as double) as waterline", "cast(null as double) as toe", "false as assumed", "cast(null as array<double>) as relief")
    cells = {(r.i, r.j): r.depth for r in canal.lay_sections(pings, sides, 0.4).collect()}
    assert all((i, j) in cells for i in range(5) for j in range(-7, 8))  # between the first two
    assert cells[2, 0] == pytest.approx(2 + 0.8 / 1.5, abs=0.1)
    assert not any(6 <= i <= 13 for i, _ in cells)  # 4.5 m are too far
    assert (16, 0) not in cells  # a metre, but seven seconds


def test_a_track_spread_over_tasks_gives_the_same_pings(spark, tmp_path):
    (tmp_path / "c.sl3").write_bytes(canal_file(seconds=15))
    fixes = [{"t": 2300 * 604_800 + 500 + n / 5, "lon": LON + n / 5 / KX, "lat": LAT} for n in range(-50, 160)]
    (tmp_path / "c.bin").write_bytes(synthetic.log_file(fixes))
    frames = align.survey_key(spark.read.format("sl3").option("samples", "true").load(str(tmp_path))).cache()
    track = align.combine_fixes(spark.read.format("bin_log").load(str(tmp_path))).cache()
    sync = align.find_alignment(frames, track).cache()
    one, many = (read.steady_track(read.placed_pings(frames, track, sync, track_rows=n), n).select("ping", "x", "y", "hx", "hy", "height", "along", "run").orderBy("ping").collect() for n in (None, 20))
    assert len(one) > 20 and one == many
