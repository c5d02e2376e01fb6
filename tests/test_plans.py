"""Readers, alignment, export and lake model on recordings with known truth."""

import json
import math

import pytest

from fathom.plans import align, export, lake
from fathom.sources import synthetic

LON, LAT = 10.0, 50.0
KX = 111_320 * math.cos(math.radians(LAT))
CLOCK = 137.25
GPS0 = 2300 * 604_800 + 123_456.0


def path(t):
    """A boat on a wavy course, by the sonar's clock."""
    x, y = 1.0 * t, 12 * math.sin(t / 15) + 0.002 * t * t
    return LON + x / KX, LAT + y / 111_320


def recording(seconds=120, rate=10, depth=lambda t: 3.0, **more):
    out = []
    for n in range(seconds * rate):
        t = n / rate
        lon, lat = path(t)
        out.append({"time_ms": round(t * 1000), "lon": lon, "lat": lat, "depth_m": depth(t), "channel": (0, 5)[n % 2], **more})
    return synthetic.sonar_file(out)


def track(seconds=120, rate=5, shift=lambda t: (0.0, 0.0), skip=lambda t: False):
    out = []
    for n in range(-20 * rate, (seconds + 20) * rate):
        t = n / rate
        if not skip(t):
            lon, lat = path(t)
            dx, dy = shift(t)
            out.append({"t": GPS0 + CLOCK + t, "lon": lon + dx / KX, "lat": lat + dy / 111_320})
    return out


@pytest.fixture
def survey(spark, tmp_path):
    def make(sonar: bytes, *logs: bytes, samples=True):
        (tmp_path / "a.SL3").write_bytes(sonar)
        for i, log in enumerate(logs):
            (tmp_path / f"log{i}.bin").write_bytes(log)
        frames = align.survey_key(spark.read.format("sl3").option("samples", str(samples).lower()).load(str(tmp_path)))
        fixes = align.combine_fixes(spark.read.format("bin_log").load(str(tmp_path)))
        return frames.cache(), fixes.cache()

    return make


def test_straight_pass_recovers_the_clock(survey, tmp_path):
    frames, fixes = survey(recording(), synthetic.log_file(track()))
    sync = align.find_alignment(frames, fixes).cache()
    s = sync.first()
    assert s.trusted and s.gps_coverage_fraction == 1.0 and s.p90_position_error_m < 2
    origin = fixes.first().gps_origin
    assert abs(origin + s.offset_s - (GPS0 + CLOCK)) <= 0.25
    table = export.aligned(frames, fixes, sync, [0, 5]).cache()
    assert table.columns[1:] == export.COLUMNS and table.count() == 1200
    r = table.orderBy("ping_id").first()
    assert (r.ping_id, r.channel_name, r.gps_source, r.gps_week) == (1, "primary", "ardupilot_bin", 2300)
    assert abs(r.gps_milliseconds_of_week - (123_456 + CLOCK) * 1000) <= 250 and abs(r.recorded_depth_m - 3) < 1e-6
    assert r.raw_intensity_mean_0_255 == 16 and r.sample_count == 32
    report = json.loads(export.quality_report(table, fixes, sync).first().report)
    assert report["exported_pings"] == 1200 and report["channels"] == {"primary": 600, "sidescan": 600} and report["bin_position_adoption_fraction"] == 1.0
    summary = export.recording_summary(frames).first()
    assert summary.primary == 600 and abs(summary.median_depth - 3) < 1e-6 and len(summary.route) == 180
    scans = export.scan_times(align.scan_points(frames, fixes, sync), fixes, sync)
    geo = json.loads(export.route_geojson(fixes, scans, "x").first().geojson)
    assert geo["features"][0]["geometry"]["type"] == "LineString" and 2 <= len(geo["features"]) <= 9
    export.write_csv(table, str(tmp_path / "csv"))
    (made,) = (tmp_path / "csv").glob("survey=*/part-*")
    want = [r.line for r in export.csv_lines(table).orderBy("ping_id").collect()]
    assert made.read_bytes().decode() == "".join(f"{line}\r\n" for line in [",".join(export.COLUMNS), *want])
    export.write_lines(export.gpx_lines(fixes, scans, "a & b"), str(tmp_path / "gpx"))
    (made,) = (tmp_path / "gpx").glob("survey=*/part-*")
    gpx = export.route_gpx(fixes, scans, "a & b").first().gpx
    assert made.read_text().split() == gpx.split()
    assert gpx.count("<trkpt") == fixes.count() and "a &amp; b" in gpx
    line = export.csv_lines(table).orderBy("ping_id").first().line
    assert line.startswith("1,0,primary,0,8,0,2300,") and len(line.split(",")) == 25


def test_wrong_trip_is_not_trusted(survey):
    frames, fixes = survey(recording(), synthetic.log_file(track(shift=lambda t: (5000, 0))))
    s = align.find_alignment(frames, fixes).first()
    assert not s.trusted and s.reason == "failed accuracy or coverage"


def test_gaps_and_far_fixes_fall_back(survey):
    frames, fixes = survey(recording(), synthetic.log_file(track(skip=lambda t: 30 < t < 33, shift=lambda t: (0, 9) if 60 < t < 80 else (0, 0))))
    sync = align.find_alignment(frames, fixes)
    table = export.aligned(frames, fixes, sync, [0]).select("sonar_time_ms", "gps_source", "bin_latitude_deg").collect()
    by = {r.sonar_time_ms / 1000: r for r in table}
    assert by[31.6].gps_source == "sl3_embedded" and by[31.6].bin_latitude_deg is None
    assert by[70.0].gps_source == "sl3_embedded" and by[70.0].bin_latitude_deg is not None
    assert by[10.0].gps_source == "ardupilot_bin"


def test_lake_of_a_tilted_plane(spark, survey):
    pings, t = [], 0.0
    for k in range(12):
        for n in range(60):
            x, y = (n if k % 2 == 0 else 59 - n) * 0.5, k * 1.5
            pings.append({"time_ms": round(t * 1000), "lon": LON + x / KX, "lat": LAT + y / 111_320, "depth_m": 2 + 0.05 * x})
            t += 0.2
    frames, fixes = survey(synthetic.sonar_file(pings), synthetic.log_file(track()))
    sync = align.find_alignment(frames, fixes)
    model = lake.lake_model(frames, fixes, sync, radius_m=2.0)
    cells = model.cells.collect()
    spread = lake.lake_model(frames, fixes, sync, radius_m=2.0, track_rows=100).cells
    assert {(c.i, c.j, c.source, c.n, round(c.depth, 9)) for c in cells} == {(c.i, c.j, c.source, c.n, round(c.depth, 9)) for c in spread.collect()}
    measured = [c for c in cells if c.source == lake.MEASURED]
    filled = [c for c in cells if c.source == lake.INTERPOLATED]
    assert model.cell_m == 1.0 and measured and filled
    low, high = min(c.depth for c in measured), max(c.depth for c in measured)
    assert all(low <= c.depth <= high for c in filled)
    at = {(c.i, c.j) for c in measured}
    assert all(any((c.i - i) ** 2 + (c.j - j) ** 2 <= 4 for i, j in at) for c in filled)
    cover = model.coverage().first()
    assert cover.measured_cells == len(measured) and cover.estimated_cells == len(filled)


@pytest.mark.parametrize(
    ("damage", "said"),
    [(lambda b: b"\x04" + b[1:], "not an SL3"), (lambda b: b[:-5], "cut off"), (lambda b: b[:8], "no frames"), (lambda b: b + b"\0" * 20, "after the last frame"), (lambda b: b[:16] + b"\x10\x00" + b[18:], "a frame of 16 bytes")],
)
def test_damaged_recordings(spark, tmp_path, damage, said):
    (tmp_path / "x.sl3").write_bytes(damage(recording(seconds=1)))
    with pytest.raises(Exception, match=said):
        spark.read.format("sl3").load(str(tmp_path)).count()


def test_log_rules(spark, tmp_path):
    good = [{"t": GPS0 + i, "lon": LON, "lat": LAT} for i in range(12)]
    bad = [{"t": GPS0 + 50, "lon": LON, "lat": LAT, "instance": 1}, {"t": GPS0 + 51, "lon": LON, "lat": LAT, "status": 2}, {"t": GPS0 + 52, "lon": 0, "lat": 0}]
    (tmp_path / "a.bin").write_bytes(synthetic.log_file(good + bad, junk=b"\xa3\x00\xa3\x95\x07zz"))
    (tmp_path / "b.bin").write_bytes(synthetic.log_file([dict(g, lon=LON + 1) for g in good]))
    read = spark.read.format("bin_log").load(str(tmp_path))
    assert read.count() == 24
    one = align.combine_fixes(read).collect()
    assert len(one) == 12 and all(r.lon == LON and r.t == r.absolute_t - GPS0 for r in one)
    from fathom.sources import fixes_from_files, frames_from_files
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin")).withColumn("log_ordinal", F.when(F.col("path").endswith("a.bin"), 0).otherwise(1))
    assert sorted(map(tuple, fixes_from_files(files).collect())) == sorted(map(tuple, read.collect()))
    (tmp_path / "s.sl3").write_bytes(recording(seconds=2))
    stored = frames_from_files(spark.read.format("binaryFile").load(str(tmp_path / "s.sl3")), samples=True)
    assert stored.count() == spark.read.format("sl3").load(str(tmp_path)).count() == 20


def test_each_lake_has_its_own_cells_and_depths_everywhere(spark):
    from fathom.plans.lake import LakeModel, cell_sizes, depths_at

    rows = [("small", float(x), float(y), 2.0 + x / 10) for x in range(0, 20, 2) for y in range(0, 20, 2)] + [("large", 30.0 * x, 30.0 * y, 9.0) for x in range(40) for y in range(40)]
    points = spark.createDataFrame([(s, x, y, d, 0.0, "bin") for s, x, y, d in rows], "survey string, x double, y double, depth double, t double, gps_source string")
    sizes = {r.survey: r.cell_m for r in cell_sizes(points, 2000).collect()}

    def plain(extent, most):
        """The size by a loop that grows it."""
        cell = max(1.0, math.sqrt((extent + 4) ** 2 / (most - 1)))
        while (math.ceil((extent + cell) / cell) + 2) ** 2 > most:
            cell *= 1.01
        return cell

    assert sizes["small"] == 1.0 and sizes["large"] == pytest.approx(plain(1170.0, 2000))
    cells = [("small", 1.0, i, j, 2.0 + i / 10) for i in range(0, 20, 2) for j in range(0, 20, 2)]
    model = LakeModel(points, spark.createDataFrame(cells, "survey string, cell_m double, i long, j long, depth double"), 1.0)
    asked = spark.createDataFrame([("small", 4.0, 6.0, 1), ("small", -500.0, 3.0, 2), ("small", 17.0, 900.0, 3), ("none", 1.0, 1.0, 4)], "survey string, x double, y double, k int")
    got = {r.k: r.depth for r in depths_at(model, asked).collect()}
    assert got == {1: pytest.approx(2.4), 2: pytest.approx(2.0), 3: pytest.approx(3.6), 4: None}
