"""Web archives: WARC records in Zstandard frames, written and read by Spark.

An archive begins with a skippable frame that holds the compression dictionary, and has one frame for
each record. Between records stands an empty skippable frame, which every Zstandard reader passes over; it lets
Spark's text writer put the frames on any store that Spark can write, with its commit protocol, so a lost executor
leaves no half archive. The reader takes the archives of a folder as binary files, loads the dictionary from the
leading frame, decodes frame by frame, and checks each record's version line, headers, lengths and digest.

Of records with equal payloads (SHA-1 and length) of at least `least` bytes, the one with the smallest page id is a response
with the payload; the others are revisits that refer to it and carry the same HTTP headers without the payload. Groups are
counted by digest before anything moves, and the page texts only shuffle where the table of repeated digests is too
large to be broadcast; then hot digests are broadcast still.

Rows that repeat the smallest id of their group are responses too: a page doesn't revisit itself. Null html is an empty
payload, a null url leaves out the target, a null id revisits the group's smallest id, or is a response where there is
none. Long pages are records like others. An empty table gives an empty result. Other columns aren't read.

A task writes what Spark deals to it, in archives of at most ARCHIVE_ROWS records; a reading task holds the archives of one
scan partition, that is spark.sql.files.maxPartitionBytes of them or a single one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import cut, lookup, ready

# Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "warc-type", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

#: An empty skippable frame; all its bytes are ASCII, so it can be the text writer's line separator.
BETWEEN = struct.pack("<II", 0x184D2A50, 0)
ARCHIVE_ROWS = 20_000
#: The dictionary is trained on the starts of so many pages, those with the lowest hashes; some four times as many reach the driver.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 4096, 64 << 10
LEVEL = 3
#: Bytes that the decoder gets at a time, so that what lies behind a frame is never copied whole.
STEP = 1 << 14


class Damaged(ValueError):
    """What a record or an archive breaks of its format."""


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def target(url: str) -> str:
    """The url without what would end or break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response, or where `first` is given a revisit of that page."""
    digest = digest_text(hashlib.sha1(payload, usedforsecurity=False).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url:
        headers.append(("WARC-Target-URI", target(url)))
    if page is not None:
        headers.append(("WARC-Page-ID", str(page)))
    if first is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Page-ID", str(first))], http)


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """Names in lower case with their values, and where the block begins."""
    if not data.startswith(VERSION):
        raise Damaged("no version line")
    end = data.find(END)
    if end < 0:
        raise Damaged("headers without an end")
    found: dict[str, str] = {}
    try:
        lines = data[len(VERSION) : end].decode().split("\r\n")
    except UnicodeDecodeError:
        raise Damaged("headers aren't UTF-8") from None
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or name.lower() in found:
            raise Damaged("a bad header line")
        found[name.lower()] = value.strip()
    if missing := [n for n in MANDATORY if not found.get(n)]:
        raise Damaged(f"no {missing[0]}")
    if found["warc-type"] not in TYPES:
        raise Damaged("an unknown type")
    return found, end + len(END)


def length_of(text: str | None) -> int:
    if text is None or not re.fullmatch(r"[0-9]{1,18}", text):
        raise Damaged("a bad length")
    return int(text)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, once its lengths are right."""
    headers, start = headers_of(data)
    end = start + length_of(headers["content-length"])
    if data[end:] != END:
        raise Damaged("the block's length differs")
    return headers, data[start:end]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload itself, which a revisit hasn't."""
    kind = headers["warc-type"]
    digest = re.fullmatch(r"sha1:([A-Z2-7]{32})", headers.get("warc-payload-digest", ""))
    end = block.find(END)
    if not block.startswith(b"HTTP/") or end < 0:
        raise Damaged("no HTTP headers")
    told = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*(?=\r\n)", block[: end + 2], re.IGNORECASE)
    length = length_of(told and told[1].decode())
    payload = block[end + len(END) :]
    if not digest:
        raise Damaged("a bad digest")
    if kind == "revisit":
        if payload or not headers.get("warc-profile") or not headers.get("warc-refers-to"):
            raise Damaged("a bad revisit")
        return length, digest[1], None
    if len(payload) != length:
        raise Damaged("the payload's length differs")
    if digest_text(hashlib.sha1(payload, usedforsecurity=False).digest()) != digest[1]:
        raise Damaged("the payload's digest differs")
    return length, digest[1], payload


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[tuple[int, bytes | Damaged]]:
    """Offset and content of each frame. After a frame that can't be read nothing follows."""
    view, at, known = memoryview(data), 0, None
    try:
        while at < len(view):
            begin = at
            magic = bytes(view[at : at + 4])
            if len(magic) == 4 and struct.unpack("<I", magic)[0] in SKIPPABLE:
                if at + 8 > len(view) or (end := at + 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]) > len(view):
                    raise Damaged("a cut-off skippable frame")
                if begin == 0 and struct.unpack("<I", magic)[0] == DICTIONARY:
                    raw = bytes(view[at + 8 : end])
                    known = zstandard.ZstdCompressionDict(zstandard.decompress(raw) if raw.startswith(FRAME) else raw)
                at = end
                continue
            if magic != FRAME:
                raise Damaged("no frame")
            decoder, out = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), []
            while not decoder.eof:
                chunk = view[at : at + STEP]
                if not chunk:
                    raise Damaged("a cut-off frame")
                out.append(decoder.decompress(chunk))
                at += len(chunk)
            at -= len(decoder.unused_data)
            yield begin, b"".join(out)
    except (Damaged, zstandard.ZstdError) as e:
        yield begin, e if isinstance(e, Damaged) else Damaged(f"a damaged frame: {e}")


def sampled_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """A dictionary trained on the starts of at most SAMPLE_PAGES pages; empty where these are too few for one."""
    start = F.substring(F.col(html_col).cast("string"), 1, SAMPLE_CHARS)
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, pages.count()))
    lowest = F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
    drawn = pages.select(start.alias("start"), F.xxhash64(id_col, start).alias("mark")).where((F.col("mark") <= lowest) & (F.length("start") > 0))
    rows = drawn.orderBy("mark", "start").limit(SAMPLE_PAGES).collect()
    samples = [r["start"].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too alike or too short
        return b""


def typed(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, first): first is the page that a revisit refers to, null for responses."""
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1 and first is not null"))
    of = groups.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    found = lookup(rows, groups, "digest", of["rows"], 100, "n", of["total"])
    return found.select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_rows: int = ARCHIVE_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row to archives in the folder path, which must be new."""
    ready(pages.sparkSession)
    dictionary = sampled_dictionary(pages, id_col, html_col)
    software = b"software: fathom\r\nformat: WARC File Format 1.1\r\n"
    about = record("warcinfo", [("WARC-Record-ID", record_id(None, "warcinfo")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], software)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        # A row is a frame; each archive's first row also has the frames that lead it.
        lead = (dictionary_frame(dictionary) if dictionary else b"") + packer.compress(about)
        done = 0
        for b in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.append(lead * (done % archive_rows == 0) + packer.compress(page_record(*row, date)))
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array(made, type=pa.binary())], names=["frame"])

    rows = typed(pages, least, id_col, url_col, html_col).mapInArrow(run, "frame binary")
    writer = rows.select(F.col("frame").cast("string").alias("value")).write
    writer.option("lineSep", BETWEEN.decode()).option("maxRecordsPerFile", archive_rows).option("compression", "none").text(path)


READ = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("problem", T.StringType()),
    ]
)


def _number(text: str | None) -> int | None:
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text) or not -(1 << 63) <= int(text) < 1 << 63:
        if text is not None:
            raise Damaged("a bad page id")
        return None
    return int(text)


def read_record(data: bytes | Damaged, payload: bool = True) -> list:
    """The columns of READ from record_type on. What a damaged record holds is not trusted: only the problem is told."""
    try:
        if isinstance(data, Damaged):
            raise data
        headers, block = parse(data)
        kind, get = headers["warc-type"], headers.get
        size, digest, body = payload_of(headers, block) if kind in ("response", "revisit") else (len(block), None, block)
        page, to = _number(get("warc-page-id")), _number(get("warc-refers-to-page-id"))
        if to is not None and get("warc-refers-to") != record_id(to, digest or ""):
            raise Damaged("it refers to another record")
        return [kind, headers["warc-record-id"], get("warc-target-uri"), page, to, get("warc-refers-to"), size, digest, body if payload else None, None]
    except Damaged as e:
        return [None] * 9 + [str(e)]


def read_archives(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives in a folder, or matched by a glob. strict: a damaged record or archive fails the job with its
    place; else it's a row with a problem, and an archive is read up to the first frame that can't be decoded."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                made: list[list] = []
                held = 0
                for at, content in frames(data.as_buffer() if data.is_valid else b""):
                    made.append([name, at, *read_record(content, payload)])
                    if strict and made[-1][-1]:
                        raise Damaged(f"{name} at byte {at}: {made[-1][-1]}")
                    held += 0 if isinstance(content, Damaged) else len(content)
                    if len(made) >= 1000 or held >= 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(READ.names, m, strict=True)) for m in made], schema=shape)
                        made, held = [], 0
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(READ.names, m, strict=True)) for m in made], schema=shape)

    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    shape = pa.schema([(f.name, kinds[f.dataType]) for f in READ.fields])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def query(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the checkpoint folder, read back and removed."""
    spark = ready(pages.sparkSession)
    place = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, place)
    found = cut(read_archives(spark, place, payload=False).where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return found


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) b, sha1(coalesce(html, '')) h from pages),
g as (select *, min(page_id) over (partition by h, b) first, count(*) over (partition by h, b) n from p)
select page_id, b as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
    case when n = 1 or first is null or page_id = first then 'response' else 'revisit' end as record_type,
    case when n = 1 or first is null or page_id = first then null else first end as refers_to
from g
"""
