"""SL3 recordings: a chain of little-endian frames, each a header and the samples of one ping.

`spark.read.format("sl3").load(path)` reads files that every worker can open, through a memory map.
`frames_from_files` reads the same rows from a binaryFile DataFrame, so from any store of Spark's.

Only what is asked for is read: filters on channel, time_ms and recording_id are pushed to the reader, which then
decodes the headers of fitting frames only (Spark does so once spark.sql.python.filterPushdown.enabled is true, as
`fathom.sources.register` sets it), and payloads are touched only where the column samples is in the schema: with the option
samples=true, or by .schema("channel int, samples binary"), which also narrows the columns.

A frame's place is only known from the one before. `index_recordings` walks the chains once, a file a task, and leaves a small
index beside each recording (or in a folder of its own); with one, a recording is read by as many tasks as it has
chunks, and chunks without a fitting channel or time are passed over unopened. An index whose recording has
changed its size since is not used.

A damaged file fails the read: wrong opening, no frame, a frame smaller than its header, or one
that runs past the end. Behind an index only the chunks that are read are looked at.
"""

from __future__ import annotations

import glob
import json
import mmap
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fathom.functions.geo import FEET_TO_METRES, MERCATOR_RADIUS

# The file's layout.
MAGIC = 3
FIRST_FRAME = 8
LEAST_HEADER = 128
LONG_HEADER, SHORT_HEADER, LAST_LONG_CHANNEL = 168, 128, 5

SCHEMA = (
    "recording_id string, offset bigint, size int, channel int, index bigint, min_range_ft double, max_range_ft double, depth_m double, "
    "lon double, lat double, time_ms bigint, ping_offset bigint, ping_size int"
)
WITH_SAMPLES = SCHEMA + ", samples binary"


class DamagedRecording(ValueError):
    """The file isn't a complete recording."""


#: Header fields that rows come from, at their places in a frame.
HEADER = np.dtype(
    {
        "names": ["size", "channel", "index", "low", "high", "payload", "depth", "x", "y", "time"],
        "formats": ["<u2", "<u2", "<u4", "<f4", "<f4", "<u2", "<f4", "<i4", "<i4", "<u4"],
        "offsets": [8, 12, 16, 20, 24, 44, 48, 92, 96, 124],
        "itemsize": LEAST_HEADER,
    }
)
#: Frames decoded at a time, and bytes of a recording that an index makes one chunk of.
BATCH, CHUNK_BYTES = 4096, 64 << 20


@dataclass
class Wanted:
    """The columns to be read, and for header columns the least and greatest value and the values allowed."""

    columns: list[str]
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def take(self, f: ds.Filter) -> bool:
        """Whether the reader applies a filter wholly."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, ds.IsNotNull):
            return name in ("channel", "time_ms", "recording_id")  # none of them is ever null
        if name == "recording_id" and isinstance(f, (ds.EqualTo, ds.In)):
            self._among(name, [f.value] if isinstance(f, ds.EqualTo) else f.value)
        elif name not in ("channel", "time_ms"):
            return False
        elif isinstance(f, (ds.EqualTo, ds.In)):
            self._among(name, [f.value] if isinstance(f, ds.EqualTo) else f.value)
        elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            self.low[name] = max(self.low.get(name, f.value), f.value + isinstance(f, ds.GreaterThan))
        elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
            self.high[name] = min(self.high.get(name, f.value), f.value - isinstance(f, ds.LessThan))
        else:
            return False
        return True

    def _among(self, name: str, values: Iterable) -> None:
        values = {v for v in values if v is not None}
        self.among[name] = self.among[name] & values if name in self.among else values

    def recording(self, name: str) -> bool:
        return name in self.among.get("recording_id", (name,))

    def chunk(self, entry: dict) -> bool:
        """Whether a chunk of an index may hold a fitting frame."""
        t0, t1 = entry["time_ms"]
        times = self.among.get("time_ms")
        inside = t1 >= self.low.get("time_ms", t1) and t0 <= self.high.get("time_ms", t0) and (times is None or any(t0 <= t <= t1 for t in times))
        return inside and bool(self.mask("channel", np.array(entry["channels"])).any())

    def mask(self, name: str, values: np.ndarray) -> np.ndarray:
        ok = np.ones(len(values), dtype=bool)
        if name in self.low:
            ok &= values >= self.low[name]
        if name in self.high:
            ok &= values <= self.high[name]
        if name in self.among:
            ok &= np.isin(values, list(self.among[name]))
        return ok


def places(data, name: str, start: int = FIRST_FRAME, end: int | None = None) -> Iterator[np.ndarray]:
    """The places of the frames from start to end, in batches: only each frame's size and channel are looked at."""
    whole = len(data)
    if start == FIRST_FRAME and (whole < FIRST_FRAME or struct.unpack_from("<H", data, 0)[0] != MAGIC):
        raise DamagedRecording(f"{name}: not an SL3 recording")
    at, end, found, none = start, whole if end is None else end, [], True
    head = struct.Struct("<H2xH").unpack_from
    while at < end:
        if at + LEAST_HEADER > whole:
            raise DamagedRecording(f"{name}: {whole - at} bytes after the last frame")
        size, channel = head(data, at + 8)
        if size < (LONG_HEADER if channel <= LAST_LONG_CHANNEL else SHORT_HEADER):
            raise DamagedRecording(f"{name}: a frame of {size} bytes at {at}")
        if at + size > whole:
            raise DamagedRecording(f"{name}: the frame at {at} is cut off")
        found.append(at)
        at += size
        if len(found) == BATCH:
            none = False
            yield np.array(found)
            found = []
    if found:
        yield np.array(found)
    elif none:
        raise DamagedRecording(f"{name}: no frames")


def headers(data, at: np.ndarray) -> np.ndarray:
    """The decoded headers at these places."""
    held = np.frombuffer(data, dtype=np.uint8)
    return held[at[:, None] + np.arange(LEAST_HEADER)].reshape(-1).view(HEADER)


def frames(data, name: str, wanted: Wanted, start: int = FIRST_FRAME, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """The fitting frames of a bytes-like object, in file order, with the wanted columns."""
    shape = arrow(wanted.columns)
    for at in places(data, name, start, end):
        h = headers(data, at)
        ok = wanted.mask("channel", h["channel"]) & wanted.mask("time_ms", h["time"])
        at, h = at[ok], h[ok]
        if not len(at):
            continue
        header = np.where(h["channel"] <= LAST_LONG_CHANNEL, LONG_HEADER, SHORT_HEADER)
        held = np.minimum(h["payload"], h["size"] - header)
        made = {
            "recording_id": lambda: [name] * len(at),
            "offset": lambda: at,
            "size": lambda: h["size"],
            "channel": lambda: h["channel"],
            "index": lambda: h["index"],
            "min_range_ft": lambda: h["low"],
            "max_range_ft": lambda: h["high"],
            "depth_m": lambda: h["depth"].astype(float) * FEET_TO_METRES,
            "lon": lambda: np.degrees(h["x"] / MERCATOR_RADIUS),
            "lat": lambda: np.degrees(2 * np.arctan(np.exp(h["y"] / MERCATOR_RADIUS)) - np.pi / 2),
            "time_ms": lambda: h["time"],
            "ping_offset": lambda: at + header,
            "ping_size": lambda: held,
            "samples": lambda: [bytes(data[a : a + n]) for a, n in zip((at + header).tolist(), held.tolist())],
        }
        kinds = {f.name: f.type for f in shape}
        columns = [pa.array(v.astype(kinds[c].to_pandas_dtype()) if isinstance(v := made[c](), np.ndarray) else v, type=kinds[c]) for c in wanted.columns]
        yield pa.RecordBatch.from_arrays(columns, schema=shape) if columns else pa.RecordBatch.from_struct_array(pa.array([{}] * len(at), type=pa.struct([])))


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


NAMES = [p.split()[0] for p in WITH_SAMPLES.split(", ")]


def arrow(columns: list[str]) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    of = dict(p.split() for p in WITH_SAMPLES.split(", "))
    return pa.schema([pa.field(c, kinds[of[c]]) for c in columns])


def files_of(path: str, ending: str) -> list[str]:
    """The files of a path, folder or pattern, by name; the ending counts in either case."""
    path = path.removeprefix("file://")
    found = [os.path.join(path, f) for f in os.listdir(path)] if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(path) or f.lower().endswith(ending))


class _File(InputPartition):
    def __init__(self, path: str, number: int, start: int = FIRST_FRAME, end: int | None = None):
        self.path, self.number, self.start, self.end = path, number, start, end


def index_path(recording: str, folder: str | None) -> str:
    return f"{os.path.join(folder, os.path.basename(recording)) if folder else recording}.frames"


def chunks_of(path: str, chunk_bytes: int = CHUNK_BYTES) -> list[dict]:
    """The chunks of a recording: whole frames of at least so many bytes, with their times and channels."""
    made: list[dict] = []
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        for at in places(data, path):
            h = headers(data, at)
            for k in range(len(at)):  # a chunk ends at the first frame that fills it
                if not made or made[-1]["end"] - made[-1]["start"] >= chunk_bytes:
                    made.append({"start": int(at[k]), "end": int(at[k]), "frames": 0, "time_ms": [1 << 32, -1], "channels": set()})
                c, t = made[-1], int(h["time"][k])
                c["end"] = int(at[k]) + int(h["size"][k])
                c["frames"] += 1
                c["time_ms"] = [min(c["time_ms"][0], t), max(c["time_ms"][1], t)]
                c["channels"].add(int(h["channel"][k]))
            del h
    return [c | {"channels": sorted(c["channels"])} for c in made]


def index_recordings(spark: SparkSession, path: str, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the index of every recording of a path, and gives (path, chunks, frames). An index is put in its place whole, so
    tasks that are run twice do no harm; an empty or damaged recording fails the job."""
    files = files_of(path, ".sl3")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for name in b.column(0).to_pylist():
                if not os.path.getsize(name):
                    raise DamagedRecording(f"{name}: empty")
                found = chunks_of(name, chunk_bytes)
                place = index_path(name, folder)
                draft = f"{place}.{os.getpid()}"
                with open(draft, "w") as f:
                    json.dump({"bytes": os.path.getsize(name), "chunks": found}, f)
                os.replace(draft, place)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(found)], pa.int32()), pa.array([sum(c["frames"] for c in found)], pa.int64())], names=["path", "chunks", "frames"])

    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return spark.createDataFrame(listed.repartition(max(1, len(files))).mapInArrow(run, "path string, chunks int, frames long").collect(), "path string, chunks int, frames long")


def indexed(path: str, folder: str | None) -> list[dict] | None:
    """The chunks of a recording's index; None without one that fits the recording."""
    try:
        with open(index_path(path, folder)) as f:
            found = json.load(f)
    except OSError:
        return None
    return found["chunks"] if found["bytes"] == os.path.getsize(path) else None


class SonarReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.folder = options["path"], options.get("index")
        self.wanted = Wanted(columns)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[InputPartition]:
        parts = []
        for number, f in enumerate(files_of(self.path, ".sl3")):
            if not self.wanted.recording(os.path.basename(f)):
                continue
            found = indexed(f, self.folder)
            parts += [_File(f, number)] if found is None else [_File(f, number, c["start"], c["end"]) for c in found if self.wanted.chunk(c)]
        return parts or [_File("", -1)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        if os.path.getsize(partition.path) == 0:
            raise DamagedRecording(f"{partition.path}: empty")
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield from frames(data, os.path.basename(partition.path), self.wanted, partition.start, partition.end)


class SonarDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sl3"

    def schema(self) -> str:
        return WITH_SAMPLES if self.options.get("samples", "false").lower() == "true" else SCHEMA

    def reader(self, schema: StructType) -> SonarReader:
        if strange := [f.name for f in schema.fields if f.name not in NAMES]:
            raise ValueError(f"a recording has no column {strange[0]}")
        return SonarReader(dict(self.options), [f.name for f in schema.fields])


def frames_from_files(files: DataFrame, samples: bool = False, channels: list[int] | None = None) -> DataFrame:
    """Frames of a DataFrame with path and content, as spark.read.format("binaryFile") gives it, of the channels if named."""
    wanted = Wanted(NAMES if samples else NAMES[:-1], among={} if channels is None else {"channel": set(channels)})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from frames(content, os.path.basename(path), wanted)

    return files.select("path", "content").mapInArrow(run, WITH_SAMPLES if samples else SCHEMA)
