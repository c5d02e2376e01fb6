"""Vehicle logs: self-describing packets, of which the GPS ones become fixes.

A packet is A3 95, a code, and a body whose layout the log's own format packets (code 128) declare.
Bytes that start no known packet are skipped one by one. Kept are fixes of the first receiver
(instance 0, or none stated) with status 3 or better, a valid position, and a GPS time.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fathom.sources.sonar import _File, batches, files_of

# Packet opening, format packets, and the types' struct codes and scales.
OPENING = b"\xa3\x95"
FORMAT_CODE, FORMAT_LENGTH = 128, 89
TYPES = {
    "b": "b", "B": "B", "h": "h", "H": "H", "i": "i", "I": "I", "q": "q", "Q": "Q", "f": "f", "d": "d",
    "c": "h", "C": "H", "e": "i", "E": "I", "L": "i", "M": "B", "n": "4s", "N": "16s", "Z": "64s",
}
SCALES = {"c": 100, "C": 100, "e": 100, "E": 100, "L": 10_000_000}
LEAST_STATUS = 3
WEEK_SECONDS = 604_800

SCHEMA = "recording_id string, log_ordinal int, byte_offset bigint, absolute_t double, lon double, lat double, altitude_m double, speed_mps double, satellites int, hdop double, status int"


def text_field(b: bytes) -> str:
    return b.split(b"\0", 1)[0].decode("utf-8", "replace")


class Layout:
    """A declared packet: its length, name and fields; unknown types make it unreadable."""

    def __init__(self, body: bytes):
        self.code, self.length = body[0], body[1]
        self.name, kinds = text_field(body[2:6]), text_field(body[6:22])
        self.fields = text_field(body[22:86]).split(",")
        self.known = all(k in TYPES for k in kinds)
        self.kinds = kinds
        self.struct = struct.Struct("<" + "".join(TYPES[k] for k in kinds)) if self.known else None

    def values(self, data, at: int) -> dict[str, object] | None:
        if self.struct is None or self.struct.size > self.length - 3:
            return None
        raw = self.struct.unpack_from(data, at + 3)
        return {f: None if k in "nNZ" else v / SCALES[k] if k in SCALES else v for f, k, v in zip(self.fields, self.kinds, raw)}


def number(v: object) -> float | None:
    return float(v) if isinstance(v, (int, float)) and math.isfinite(v) else None


def fixes(data, name: str, ordinal: int) -> Iterator[tuple]:
    """The usable fixes in a bytes-like object, in file order."""
    layouts: dict[int, Layout] = {}
    at, end = 0, len(data)
    while True:
        at = data.find(OPENING, at)
        if at < 0 or at + 3 > end:
            return
        code = data[at + 2]
        length = FORMAT_LENGTH if code == FORMAT_CODE else layouts[code].length if code in layouts else 0
        if length < 3 or at + length > end:
            at += 1
            continue
        if code == FORMAT_CODE:
            layout = Layout(bytes(data[at + 3 : at + length]))
            layouts[layout.code] = layout
        elif layouts[code].name == "GPS" and (v := layouts[code].values(data, at)) is not None:
            lon, lat, week, ms = (number(v.get(k)) for k in ("Lng", "Lat", "GWk", "GMS"))
            valid = None not in (lon, lat, week, ms) and abs(lon) <= 180 and abs(lat) <= 90 and (lon != 0 or lat != 0)
            if valid and (v.get("I") or 0) == 0 and (number(v.get("Status")) or 0) >= LEAST_STATUS:
                sats = number(v.get("NSats"))
                yield (name, ordinal, at, week * WEEK_SECONDS + ms / 1000, lon, lat, number(v.get("Alt")), number(v.get("Spd")), None if sats is None else int(sats), number(v.get("HDop")), int(v["Status"]))
        at += length


def arrow() -> pa.Schema:
    i, l, d = pa.int32(), pa.int64(), pa.float64()
    return pa.schema([pa.field(p.split()[0], k) for p, k in zip(SCHEMA.split(", "), [pa.string(), i, l, d, d, d, d, d, i, d, i])])


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(f, i) for i, f in enumerate(files_of(self.path, ".bin"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if os.path.getsize(partition.path):
            with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield from batches(fixes(data, os.path.basename(partition.path), partition.number), arrow())


class LogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bin_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))


def fixes_from_files(files: DataFrame) -> DataFrame:
    """Fixes of a DataFrame with path, content and log_ordinal, read from any store as binaryFile."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, content, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield from batches(fixes(content, os.path.basename(path), n), arrow())

    return files.select("path", "content", "log_ordinal").mapInArrow(run, SCHEMA)
