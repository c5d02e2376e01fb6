"""The recording reader: pushed filters, narrow schemas, indexes; and the same rows by a plain walk."""

import json
import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from fathom.sources import index_recordings, sonar, synthetic


def pings(n, seed):
    rnd = random.Random(seed)
    return [
        {"time_ms": 100 * k + rnd.randrange(50), "lon": 10 + rnd.random(), "lat": 50 + rnd.random(), "depth_m": rnd.uniform(1, 9), "channel": rnd.choice([0, 1, 5, 9]), "max_range_m": rnd.uniform(5, 50), "samples": rnd.randbytes(rnd.choice([0, 1, 32, 300]))}
        for k in range(n)
    ]


def plain(data, name):
    """Rows by a walk that decodes field by field."""
    at, out = 8, []
    while at < len(data):
        get = lambda kind, place: struct.unpack_from("<" + kind, data, at + place)[0]  # noqa: B023, E731
        size, channel = get("H", 8), get("H", 12)
        header = 168 if channel <= 5 else 128
        held = min(get("H", 44), size - header)
        lon, lat = math.degrees(get("i", 92) / 6356752.3142), get("i", 96)
        out.append((name, at, size, channel, get("I", 16), get("f", 20), get("f", 24), get("f", 48) * 0.3048, lon, lat, get("I", 124), at + header, held, data[at + header : at + header + held]))
        at += size
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("recordings")
    for k in range(3):
        (place / f"r{k}.SL3").write_bytes(synthetic.sonar_file(pings(5000 + k, k)))
    (place / "notes.txt").write_text("not a recording")
    return place


@pytest.fixture(scope="module")
def truth(folder):
    return [r for k in range(3) for r in plain((folder / f"r{k}.SL3").read_bytes(), f"r{k}.SL3")]


def load(spark, folder, **options):
    return spark.read.format("sl3").options(**options).load(str(folder))


def test_all_rows_by_a_plain_walk(spark, folder, truth):
    got = sorted(load(spark, folder, samples="true").collect(), key=lambda r: (r.recording_id, r.offset))
    assert len(got) == len(truth)
    for r, t in zip(got, truth):
        assert (*tuple(r)[:8], *tuple(r)[10:13], bytes(r.samples)) == (*t[:8], *t[10:13], t[13])
        assert r.lon == pytest.approx(t[8], abs=0.1)


@pytest.mark.parametrize("index", [False, True])
def test_filters_are_pushed_and_leave_the_same_rows(spark, folder, truth, tmp_path, index):
    options = {}
    if index:
        made = index_recordings(spark, str(folder), str(tmp_path), chunk_bytes=100_000).collect()
        assert sum(r.frames for r in made) == len(truth) and all(r.chunks > 5 for r in made)
        options = {"index": str(tmp_path)}
        assert load(spark, folder, **options).rdd.getNumPartitions() == sum(r.chunks for r in made)
    for condition, keep in (
        ("channel = 5", lambda r: r[3] == 5),
        ("channel in (0, 9) and time_ms >= 100000 and time_ms < 200000", lambda r: r[3] in (0, 9) and 100000 <= r[10] < 200000),
        ("recording_id = 'r1.SL3' and time_ms > 499000", lambda r: r[0] == "r1.SL3" and r[10] > 499000),
        ("time_ms <= 50 and size > 200", lambda r: r[10] <= 50 and r[2] > 200),
        ("channel = 7", lambda r: False),
        ("channel = 5 or time_ms < 1000", lambda r: r[3] == 5 or r[10] < 1000),
        ("recording_id = 'none'", lambda r: False),
    ):
        got = load(spark, folder, **options).where(condition)
        assert sorted((r.recording_id, r.offset) for r in got.collect()) == [r[:2] for r in truth if keep(r)], condition
        assert got.count() == sum(map(keep, truth))


def test_a_filtered_count_reads_headers_of_few_chunks_only(spark, folder, tmp_path, monkeypatch):
    index_recordings(spark, str(folder), str(tmp_path), chunk_bytes=100_000).collect()
    reader = sonar.SonarReader({"path": str(folder), "index": str(tmp_path)}, ["channel"])
    left = reader.pushFilters([sonar.ds.GreaterThanOrEqual(("time_ms",), 495_000), sonar.ds.EqualTo(("channel",), 5), sonar.ds.GreaterThan(("size",), 3)])
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    parts = reader.partitions()
    assert {p.path[-6:] for p in parts} == {"r0.SL3", "r1.SL3", "r2.SL3"} and len(parts) <= 6
    read = [b for p in parts for b in reader.read(p)]
    assert all(b.schema.names == ["channel"] and set(b.column(0).to_pylist()) == {5} for b in read)


def test_chunks_hold_whole_frames_end_to_end(folder):
    path = str(folder / "r0.SL3")
    chunks = sonar.chunks_of(path, 50_000)
    assert chunks[0]["start"] == 8 and chunks[-1]["end"] == os.path.getsize(path)
    assert all(a["end"] == b["start"] for a, b in zip(chunks, chunks[1:])) and len(chunks) > 20
    assert sonar.chunks_of(path, 1 << 40)[0]["frames"] == 5000 == sum(c["frames"] for c in chunks)


def test_narrow_schemas_leave_payloads_alone(spark, folder, truth):
    got = spark.read.format("sl3").schema("channel int, samples binary").load(str(folder))
    assert got.columns == ["channel", "samples"]
    assert sorted((r.channel, bytes(r.samples)) for r in got.collect()) == sorted((t[3], t[13]) for t in truth)
    assert spark.read.format("sl3").schema("time_ms bigint").load(str(folder)).agg(F.sum("time_ms")).first()[0] == sum(t[10] for t in truth)
    with pytest.raises(Exception, match="no column"):
        spark.read.format("sl3").schema("nothing int").load(str(folder)).count()


def test_an_index_of_another_size_is_not_used(spark, folder, tmp_path, truth):
    (tmp_path / "r0.SL3.frames").write_text(json.dumps({"bytes": 1, "chunks": []}))
    assert load(spark, folder, index=str(tmp_path)).count() == len(truth)


def test_damaged_recordings_fail_the_index(spark, tmp_path):
    (tmp_path / "x.sl3").write_bytes(synthetic.sonar_file(pings(3, 0))[:-1])
    with pytest.raises(Exception, match="cut off"):
        index_recordings(spark, str(tmp_path))
