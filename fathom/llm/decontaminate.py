"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of digits, letters and anything beyond ASCII, with A-Z lower-cased. Every item
gives its windows of `window` consecutive words (an item with fewer words, but not none, is one
window). Each text is normalised and scanned once; hits are mapped back to word numbers and to
code points of the original text.

The automaton holds an item's chunks of about half a window, end to end: every window holds one
of them whole, so each occurrence of a window is found by a chunk. The windows of the text around a chunk are then
looked up among the items' windows, each once, and compared word by word. The automaton is then as large as the items,
not thirteen times as large, and the work follows the text's length however often words repeat.

A worker process builds it once and holds one at a time. Items are streamed to the driver in blocks
of at most AUTOMATON_BYTES. One block is scanned in a narrow pass that adds the result to each row.
With more blocks, each is scanned in a job of its own which keeps only the hits; these are then
joined to the rows by two hashes of the id and the text.

Nulls: a null text or item has no words; an item whose id is null counts for n_hit, but not for
n_items and items_sha256, as it has no id to list. Very long texts, empty tables, repeated items and
repeated rows are plain cases: every row is judged by itself, item ids are counted once. A column
named like an output column is replaced by the output.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import cut, fresh, maybe_broadcast, ready

WINDOW = 13
#: Bytes of item text in one automaton; it takes some fifty times as much of a worker's memory.
AUTOMATON_BYTES = 4 << 20
#: Texts that a worker holds as Python objects at a time.
SLICE = 256

# ASCII bytes that are part of words; bytes from 0x80 are as well.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes(b if b >= 0x80 or b in WORD_BYTES else (b | 0x20 if b in _UPPER else 0x20) for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c | 0x20 for c in _UPPER}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def normalised(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def _keys(words: np.ndarray, at: np.ndarray, size: int, turn: int) -> np.ndarray:
    """A 64-bit key of the `size` word numbers from each place on."""
    mixed = (words.astype(np.int64).view(np.uint64) + np.uint64(2 * turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + mixed[at + j]
    return out


class Windows:
    """The distinct windows of one size, with the items that hold them."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, item: np.ndarray, size: int):
        self.flat, self.size, self.turn = flat, size, 0
        while True:
            keys = _keys(flat, at, size, self.turn)
            order = np.lexsort((item, keys))
            keys, places, items = keys[order], at[order], item[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            least = places[new][np.cumsum(new) - 1]
            if all((flat[places + j] == flat[least + j]).all() for j in range(size)):
                break
            self.turn += 1  # two windows share a key: other keys
        pair = new | np.r_[True, items[1:] != items[:-1]]
        self.keys, self.at, self.items = keys[new], places[new], items[pair]
        self.ends = np.r_[np.flatnonzero(new[pair])[1:], len(self.items)]

    def find(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the starts where one of the windows begins, and which."""
        keys = _keys(text, starts, self.size, self.turn)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[k] == keys
        starts, k = starts[same], k[same]
        same = np.ones(len(k), dtype=bool)
        for j in range(self.size):
            same &= text[starts + j] == self.flat[self.at[k] + j]
        return starts[same], k[same]

    def owners(self, k: int) -> np.ndarray:
        return self.items[self.ends[k - 1] if k else 0 : self.ends[k]]


class Scanner:
    """One automaton; scan() gives the runs of words that windows cover, with the items that they come from."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        ids: dict[tuple[bytes, ...], set[str | None]] = {}
        self.known: dict[bytes, int] = {}
        for item_id, text in items:
            if w := normalised(text):
                ids.setdefault(tuple(w), set()).add(item_id)
        self.ids = [tuple(x) for x in ids.values()]
        flat = np.array([self.known.setdefault(x, len(self.known)) for w in ids for x in w], dtype=np.int32)
        chunks: dict[str, tuple[int, set[int]]] = {}
        places: dict[int, list[tuple[int, int, int]]] = {}
        begin = 0
        for k, w in enumerate(ids):
            size = min(window, len(w))
            n = (size + 1) // 2
            for at in range(0, len(w) - n + 1, n):
                line = " " + b" ".join(w[at : at + n]).decode("utf-8", "surrogatepass") + " "
                chunks.setdefault(line, (n, set()))[1].add(size)
            places.setdefault(size, []).append((begin, len(w) - size + 1, k))
            begin += len(w)
        self.windows = {}
        for size, own in places.items():
            at = np.concatenate([np.arange(a, a + n) for a, n, _ in own])
            self.windows[size] = Windows(flat, at, np.repeat([k for *_, k in own], [n for _, n, _ in own]), size)
        self.automaton = ahocorasick.Automaton()
        for line, (n, sizes) in chunks.items():
            self.automaton.add_word(line, (n, tuple(sizes)))
        if chunks:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str | None, ...]]]:
        """(first word, end word, items) of the longest runs that windows cover."""
        if not self.ids or not words:
            return []
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        hits = list(self.automaton.iter(line))
        if not hits:
            return []
        # A chunk ends at the space before the next word; the spaces up to there count its words.
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 0x20)
        ends = np.searchsorted(spaces, [e for e, _ in hits])
        text = np.array([self.known.get(w, -1) for w in words], dtype=np.int32)
        near: dict[tuple[int, int], list[int]] = {}
        for end, (_, (n, sizes)) in zip(ends.tolist(), hits):
            for size in sizes:
                near.setdefault((size, n), []).append(end)
        starts, stops, sizes, which = [], [], [], []
        for (size, n), at in near.items():
            # A window that holds the chunk begins at most size words before the chunk's end, and not after the chunk.
            open_ = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(open_, np.maximum(np.array(at) - size, 0), 1)
            np.add.at(open_, np.array(at) - n + 1, -1)
            maybe = np.flatnonzero(np.cumsum(open_)[: max(0, len(words) - size + 1)] > 0)
            begin, k = self.windows[size].find(text, maybe)
            starts.append(begin)
            stops.append(begin + size)
            sizes.append(np.full(len(begin), size))
            which.append(k)
        first, end, size, k = (np.concatenate(x) for x in (starts, stops, sizes, which))
        if not len(first):
            return []
        order = np.argsort(first, kind="stable")
        first, end, size, k = first[order], end[order], size[order], k[order]
        last = np.maximum.accumulate(end)
        new = np.r_[True, first[1:] > last[:-1]]
        run = np.cumsum(new) - 1
        owners: list[set[int]] = [set() for _ in range(run[-1] + 1)]
        for r, s, w in np.unique(np.stack([run, size, k], axis=1), axis=0).tolist():
            owners[r].update(self.windows[s].owners(w).tolist())
        closes = last[np.r_[np.flatnonzero(new)[1:] - 1, len(last) - 1]]
        return [(a, b, tuple({x for o in own for x in self.ids[o]})) for a, b, own in zip(first[new].tolist(), closes.tolist(), owners)]


_HELD: dict[str, Scanner] = {}


def scanner_of(name: str, items: list[tuple[str | None, str]], window: int) -> Scanner:
    """This process's automaton of a block; that of another block goes first."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Scanner(items, window)
    return _HELD[name]


def judge(text: str | None, found: list[tuple], min_share: int = 20) -> tuple:
    """The output columns of a text with its runs (first word, end word, items)."""
    w = normalised(text)
    ids, merged, spans = set(), [], []
    for a, b, own in sorted(found, key=lambda x: x[:2]):
        ids.update(x for x in own if x is not None)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    hit = sum(b - a for a, b in merged)
    if merged:
        at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged]
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), hit, len(ids), digest, hit > 0 and min_share * hit >= len(w), spans


OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = AUTOMATON_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """The items, streamed to the driver in blocks of a bounded size (a longer item is a block of its own)."""
    block, room = [], most
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        if row[1]:
            if (n := len(row[1].encode("utf-8", "surrogatepass"))) > room and block:
                yield block
                block, room = [], most
            room -= n
            block.append((row[0], row[1]))
    yield block


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def _judged(batch: pa.RecordBatch, columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    made = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_ARROW)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, *_ARROW.names])


_HITS = "k1 long, k2 long, first long, end long, items array<string>"


def block_hits(keyed: DataFrame, block: list[tuple[str | None, str]], window: int) -> DataFrame:
    """(k1, k2, first, end, items) of the hits of one block of items in keyed (k1, k2, text)."""
    shared, name = keyed.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(name, shared.value, window)
        for b in _slices(batches):
            rows = [(k1, k2, *x) for k1, k2, t in zip(*(c.to_pylist() for c in b.columns)) for x in scanner.scan(normalised(t))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["k1", "k2", "first", "end", "items"])

    hits = cut(keyed.select("k1", "k2", "text").mapInArrow(scan, _HITS).distinct())
    shared.unpersist()
    return hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (code points)."""
    spark = ready(docs.sparkSession)
    docs = docs.drop(*OUT.names)
    columns, schema = docs.columns, T.StructType([*docs.schema.fields, *OUT.fields])
    blocks = item_blocks(benchmark, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared, name = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = scanner_of(name, shared.value, window)
            for b in _slices(batches):
                yield _judged(b, columns, [judge(t, scanner.scan(normalised(t))) for t in b.column(text_col).to_pylist()])

        return docs.mapInArrow(scan, schema)
    body = [c for c, t in docs.dtypes if t != "void" and not t.startswith(("map", "variant"))]
    k1, k2, own = (fresh(n, columns) for n in ("_k1", "_k2", "_found"))
    keyed = docs.withColumn(k1, F.xxhash64(*body)).withColumn(k2, F.xxhash64(F.lit(1), *body))
    plain = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).alias("text"))
    hits = reduce(DataFrame.unionByName, [block_hits(plain, b, window) for b in chain([first, second], blocks)])
    found = cut(hits.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list(F.struct("first", "end", "items")).alias(own)))
    size = found.agg(F.coalesce(F.sum(F.size(own)), F.lit(0))).first()[0]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = [judge(t, [(x["first"], x["end"], x["items"]) for x in f or ()]) for t, f in zip(b.column(text_col).to_pylist(), b.column(own).to_pylist())]
            yield _judged(b, columns, rows)

    return keyed.join(maybe_broadcast(found, size, 256), [k1, k2], "left").select(*columns, own).mapInArrow(settle, schema)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
