"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and one separator. Whole windows of `capacity` ids are cut off; the
remainders of up to GROUP documents are merged into windows by multiway differencing: the two
partial partitions with the greatest imbalance are joined so that their imbalances oppose, until
one partition is left. The window count starts at ceil(total / capacity) and rises whenever a
window exceeds the capacity. The near-equal windows are then topped up: the lightest ones are cut
up to fill the others, and what is left over (less than one window in a group) is cut at powers
of two, which need no padding.

Documents are dealt to buckets of bounded size by a hash of the id and of the place in the
document, so a task holds a few thousand remainders whatever the table's size, and a very long
document is spread as well. Sequence ids are a bucket's number and a count in it: they are unique
and repeat exactly when a task is run again.

Nulls: a null text is empty, its document is one separator. Repeated rows are documents of their
own. An empty table gives no sequences. A row whose id is null is packed like any other.
"""

from __future__ import annotations

import base64
import heapq
import math
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ready

CAPACITY = 1024
GROUP = 512
#: Documents that a bucket holds on average, and windows of one document that stay in one bucket.
BUCKET_DOCS = 2048
RUN = 256
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of the vocabulary's JSON file, which the rank file lacks.
ADDED = {"<|endoftext|>": 50256}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def model_of(path: str):
    """The vocabulary read as ranks with its added token, once for each worker process.

    tiktoken's ids are those of the same vocabulary's JSON file under tokenizers (tests compare
    them), at a fifth of the time.
    """
    held = sys.modules.setdefault("_fathom_models", types.ModuleType("_fathom_models")).__dict__
    if path not in held:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return held[path]


def token_ids(texts: list[str | None], path: str, separator: int = SEPARATOR, added: bool = False) -> list[bytes]:
    """Ids and the separator of each text, as little-endian unsigned 32-bit integers.

    With `added`, the literal of an added token is that token, as under the JSON file's default
    settings; else it is split like any other text.
    """
    model = model_of(path)
    encode = model.encode_ordinary
    marks = tuple(ADDED) if added else ()
    made = []
    for t in texts:
        t = t or ""
        ids = model.encode(t, allowed_special="all") if any(m in t for m in marks) else encode(t)
        made.append(array("I", [*ids, separator]).tobytes())
    return made


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of sizes in k windows with near-equal sums.

    A partial partition is k sums, greatest first and the least taken off, and k nodes; a node
    is 0 (nothing), a position plus 1, or a pair of nodes made by a merge.
    """
    n = len(sizes)
    blank = np.zeros(k, dtype=np.int64)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = blank.copy(), blank.copy()
        sums[0], nodes[0] = s, i + 1
        heap.append((-s if k > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        nodes = np.where(y == 0, x, np.where(x == 0, y, n + 1 + len(merged) * k + np.arange(k)))
        merged.append((x, y))
        heapq.heappush(heap, (-int(sums[0]), n + len(merged), sums, nodes[order]))
    parts = []
    for node in heap[0][3].tolist() if heap else ():
        part, stack = [], [node]
        while stack:
            at = stack.pop()
            if at > n:
                m, j = divmod(at - n - 1, k)
                stack += [int(merged[m][0][j]), int(merged[m][1][j])]
            elif at:
                part.append(at - 1)
        parts.append(part)
    return parts


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing with as few windows as hold the capacity."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        made = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in made):
            return [w for w in made if w]
        k += max(1, k // 64)


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (position, start, length): full ones, and at most one rest cut at powers of two."""
    loads = sorted(windows(sizes, capacity), key=lambda w: sum(sizes[i] for i in w), reverse=True)
    full = sum(sizes) // capacity
    whole = [[(i, 0, sizes[i]) for i in w] for w in loads[:full]]
    spare = [(i, 0, sizes[i]) for w in loads[full:] for i in w]
    for w in whole:
        room = capacity - sum(n for _, _, n in w)
        while room:
            i, at, n = spare.pop()
            take = min(n, room)
            w.append((i, at, take))
            if take < n:
                spare.append((i, at + take, n - take))
            room -= take
    left = sum(n for _, _, n in spare)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        whole.append([])
        while room:
            i, at, n = spare.pop()
            take = min(n, room)
            whole[-1].append((i, at, take))
            if take < n:
                spare.append((i, at + take, n - take))
            room -= take
    return whole


PIECE = "doc_id long, start long, doc_tokens long, ids binary, bucket long"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pieces(docs: DataFrame, buckets: int, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's whole windows and its remainder, with the bucket that packs them."""
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for key, place, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), token_ids(batch.column(2).to_pylist(), path, added=True)):
                    for j in range(0, len(ids), step):
                        rows.append((key, j // 4, len(ids) // 4, ids[j : j + step], (place + j // step // RUN) % buckets))
                types_ = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types_)], names=["doc_id", "start", "doc_tokens", "ids", "bucket"])

    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(buckets))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("place"), text_col).mapInArrow(run, PIECE)


def _packer(capacity: int, group: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(crc=[zlib.crc32(b) for b in pdf["ids"]]).sort_values(["doc_id", "start", "doc_tokens", "crc"], kind="stable").reset_index(drop=True)
        first = int(pdf["bucket"].iloc[0]) << 32
        sizes = (pdf["ids"].str.len() // 4).astype(int).tolist()
        made = [[(i, 0, n)] for i, n in enumerate(sizes) if n == capacity]
        parts = [i for i, n in enumerate(sizes) if n < capacity]
        for at in range(0, len(parts), group):
            some = parts[at : at + group]
            made += [[(some[i], s, n) for i, s, n in w] for w in fill([sizes[i] for i in some], capacity)]
        ids, key, start, tokens = (pdf[c].tolist() for c in ("ids", "doc_id", "start", "doc_tokens"))
        out = []
        for number, w in enumerate(made):
            offset = 0
            for i, s, n in w:
                out.append((key[i], start[i] + s, n, tokens[i], first + number, offset, ids[i][4 * s : 4 * (s + n)]))
                offset += n
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each piece: where it comes from, the sequence and offset that hold it, and its ids."""
    ready(docs.sparkSession)
    buckets = max(1, math.ceil(docs.count() / BUCKET_DOCS))
    cutup = pieces(docs, buckets, path or vocabulary_path(), capacity, id_col, text_col)
    return cutup.groupBy("bucket").applyInPandas(_packer(capacity, GROUP), PACKED)


def query(docs: DataFrame) -> DataFrame:
    packed = pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
