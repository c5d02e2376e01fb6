"""WARC archives: exact round trips, SQL, odd rows, and damage."""

import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard

from fathom.llm import common, warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, first string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    """Every row against every other."""
    out = []
    for i, html in rows:
        size = len((html or "").encode())
        ids = [j for j, other in rows if (other or "") == (html or "") and j is not None]
        repeats = sum((other or "") == (html or "") for _, other in rows) > 1
        to = min(ids) if ids and repeats and size >= least and i != min(ids) else None
        out.append((i, size, digest(html), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd_rows():
    long = "".join(f"<p>paragraph {i * i} ä\U0001f600</p>" for i in range(60_000))
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, None), (6, long), (-7, long), (8, "x\r\n\r\ny"), (9, "P*M\x18\0\0\0\0"), (9, "same"), (9, "same"), (None, "same"), (None, "alone"), (None, "two"), (None, "two")]
    return rows + [(10 + k, "hot") for k in range(300)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    urls = ["http://a.example/\r\nWARC-Type: resource", None, "", "http://b.example/ä b"]
    return spark.createDataFrame([(i, urls[k % 4], h, "p", None, "f") for k, (i, h) in enumerate(odd_rows)], SCHEMA)


def test_equal_to_brute_force_and_to_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = rows_of(warc.query(table))
    assert got == plain([(r.page_id, r.html) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(con.execute(warc.ORACLE).fetchall(), key=str)


def test_odd_rows(odd, odd_rows):
    assert rows_of(warc.query(odd)) == plain(odd_rows)
    assert warc.query(odd.limit(0)).count() == 0


def test_groups_too_large_to_broadcast(odd, odd_rows, monkeypatch):
    monkeypatch.setattr("fathom.operators.skew.BROADCAST_BYTES", 1)
    assert rows_of(warc.query(odd)) == plain(odd_rows)
    assert common.BROADCAST_BYTES > 1


def test_payloads_and_targets_come_back(spark, odd, odd_rows, tmp_path):
    place = str(tmp_path / "archives")
    warc.write_archives(odd.repartition(3), place, least=3, archive_rows=70)
    read = warc.read_archives(spark, place).collect()
    kinds = [r.record_type for r in read]
    archives = {r.archive for r in read}
    assert len(archives) >= 5 and kinds.count("warcinfo") == len(archives) and not any(r.problem for r in read)
    pages = [r for r in read if r.record_type != "warcinfo"]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in pages), key=str) == plain(odd_rows, 3)
    assert sorted(bytes(r.payload) for r in pages if r.page_id == 8) == [b"x\r\n\r\ny"]
    assert {bytes(r.payload).decode() for r in pages if r.record_type == "response"} == {h or "" for _, h in odd_rows}
    assert {r.target_uri for r in pages} == {None, "http://a.example/%0D%0AWARC-Type:%20resource", "http://b.example/ä%20b"}
    of = {r.page_id: r.record_id for r in pages if r.record_type == "response" and r.page_id is not None}
    assert all(r.refers_to_id == of[r.refers_to] for r in pages if r.record_type == "revisit" and r.refers_to != 9)
    for p in (tmp_path / "archives").glob("part-*"):
        data = p.read_bytes()
        at = 0
        if struct.unpack("<I", data[:4])[0] == warc.DICTIONARY:
            at = 8 + struct.unpack("<I", data[4:8])[0]
        assert data[at : at + 4] == warc.FRAME and data.endswith(warc.BETWEEN)


def test_the_leading_dictionary_is_needed(spark, sf):
    texts = [r.html.encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    made = zstandard.train_dictionary(8192, texts).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(made))
    body = b"".join(packer.compress(t) + warc.BETWEEN for t in texts)
    for lead in (made, zstandard.compress(made)):
        assert [c for _, c in warc.frames(warc.dictionary_frame(lead) + body)] == texts
    assert isinstance(list(warc.frames(body))[0][1], warc.Damaged)
    late = packer.compress(texts[0]) + warc.dictionary_frame(made) + packer.compress(texts[0])
    assert isinstance(list(warc.frames(late))[0][1], warc.Damaged)


def test_frames_of_every_size():
    bodies = [b"", b"x", b"ab" * warc.STEP, bytes(range(256)) * 999]
    data = b"".join(zstandard.ZstdCompressor(level=1, write_content_size=k % 2 == 0).compress(b) for k, b in enumerate(bodies))
    assert [c for _, c in warc.frames(data)] == bodies and list(warc.frames(b"")) == []


@pytest.mark.parametrize(
    ("change", "says"),
    [
        (lambda d: d.replace(b"WARC/1.1", b"WARC/9.9", 1), "no version line"),
        (lambda d: d.replace(b"WARC-Date: ", b"X-Date: ", 1), "no warc-date"),
        (lambda d: d.replace(b"WARC-Type: response", b"WARC-Type: reply", 1), "an unknown type"),
        (lambda d: d.replace(b"WARC-Type", b"WARC Type", 1), "a bad header line"),
        (lambda d: d.replace(b"hello", b"hullo"), "the payload's digest differs"),
        (lambda d: d.replace(b"hello", b"hello!"), "the block's length differs"),
        (lambda d: d[:-1], "the block's length differs"),
        (lambda d: d + b"\r\n", "the block's length differs"),
        (lambda d: d.replace(b"utf-8\r\nContent-Length: 5", b"utf-8\r\nContent-Length: 6"), "the payload's length differs"),
        (lambda d: d.replace(b"Content-Type: application/http", b"Content-Length: 5\r\nContent-Type: application/http", 1), "a bad header line"),
        (lambda d: d.replace(b"sha1:", b"md5:"), "a bad digest"),
        (lambda d: d.replace(b"WARC-Page-ID: 1", b"WARC-Page-ID: one"), "a bad page id"),
        (lambda d: d.split(b"\r\n\r\n")[0], "headers without an end"),
    ],
)
def test_damaged_records(change, says):
    good = warc.page_record(1, "http://a.example/", b"hello", None, "2020-01-01T00:00:00Z")
    assert warc.read_record(good)[-1] is None
    assert warc.read_record(change(good)) == [None] * 9 + [says]


def test_revisits_are_checked():
    good = warc.page_record(2, None, b"hello", 1, "2020-01-01T00:00:00Z")
    assert warc.read_record(good)[3:7] == [2, 1, warc.record_id(1, digest("hello")), 5]
    assert warc.read_record(good.replace(b"WARC-Refers-To-Page-ID: 1", b"WARC-Refers-To-Page-ID: 3"))[-1] == "it refers to another record"
    assert warc.read_record(good.replace(b"WARC-Profile", b"X-Profile"))[-1] == "a bad revisit"


def test_damaged_archives_are_told_or_fail(spark, tmp_path):
    good = zstandard.compress(warc.page_record(1, None, b"hello", None, "2020-01-01T00:00:00Z"))
    bad = zstandard.compress(warc.page_record(2, None, b"there", None, "2020-01-01T00:00:00Z").replace(b"there", b"where"))
    for name, data in {"cut": good + good[:-3], "odd": good + b"junk", "skip": good + struct.pack("<II", 0x184D2A51, 99), "wrong": bad + good, "none": b""}.items():
        (tmp_path / name).write_bytes(data)
    read = warc.read_archives(spark, str(tmp_path), strict=False).collect()
    told = {name: [(r.page_id, r.problem) for r in sorted(read, key=lambda r: r.offset) if r.archive.endswith(f"/{name}")] for name in ("cut", "odd", "skip", "wrong", "none")}
    assert told == {
        "cut": [(1, None), (None, "a cut-off frame")],
        "odd": [(1, None), (None, "no frame")],
        "skip": [(1, None), (None, "a cut-off skippable frame")],
        "wrong": [(None, "the payload's digest differs"), (1, None)],
        "none": [],
    }
    with pytest.raises(Exception, match="the payload's digest differs"):
        warc.read_archives(spark, str(tmp_path / "wrong")).collect()
