"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints: words are runs without white space, A-Z lower-cased; shingles of `k` words,
repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is
set in over half of the shingles' XXH64 values.

Links: distinct fingerprints (copies meet in one row first) are dealt to the leaves of a
vantage-point tree. Its vantage points come from a bounded sample; every fingerprint is indexed.
At each node a fingerprint belongs to the near or the far side; by the triangle inequality only
near-side points within `radius` of the boundary can have partners on the far side, so only those
are sent there as queries, and a query goes on to each side that its ball reaches. A leaf's points
and queries are dealt to cells of bounded size, whatever the leaf has received; each cell then
recurses with vantage points of its own and compares what is left exactly. It returns each point
beside the first of its local component, never pairs, so that dense groups cost one row per
member; components of cells that share a fingerprint are joined by star contraction.

Nulls: a null text has no words, and so fingerprint zero like an empty one; these link with each
other. A null id never becomes a component's id unless all ids of the component are null.
Repeated rows, ties and empty tables need no special care: one row comes back for each row. A very
long text is read in blocks of shingles. Other columns are kept; one named like the output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import connected_components, cut, least_reachable, lookup, maybe_broadcast, parts_for, ready

SEED = 42
RADIUS = 3
#: Fingerprints from which the top tree takes its vantage points, and candidates tried at each node.
SAMPLE = 16384
TRIED = 12
LEAF = 24_000
MIN_LEAVES = 48
_BLOCK = 65_536
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def shingles(text: str | None, k: int) -> Iterator[list[bytes]]:
    """The shingles of a text, in blocks of bounded length."""
    w = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if 0 < len(w) < k:
        yield [b" ".join(w)]
    for at in range(0, len(w) - k + 1, _BLOCK):
        part = w[at : at + _BLOCK + k - 1]
        yield [b" ".join(s) for s in zip(*(part[i:] for i in range(k)))]


def hashes(parts: list[bytes], seed: int = SEED, digest=xxhash.xxh64_digest) -> np.ndarray:
    return np.frombuffer(b"".join([digest(p, seed) for p in parts]), dtype=">u8")


def fingerprint(text: str | None, k: int = 3) -> int:
    """The SimHash as a signed 64-bit integer."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for part in shingles(text, k):
        bits = np.unpackbits(hashes(part).view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n).view(">i8")[0]) if n else 0


def with_fingerprints(docs: DataFrame, text_col: str = "text", k: int = 3, name: str = "fp") -> DataFrame:
    """docs without the text, with its fingerprint as a long."""
    ready(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, k) for t in b.column(text_col).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), fps], names=[*(f.name for f in kept), name])

    return docs.select(*[f.name for f in kept], text_col).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v)


def vantage(points: np.ndarray, tried: int = TRIED) -> tuple[np.uint64, int] | None:
    """The tried point whose distances spread most, and the radius that halves the points; None if none splits them."""
    best = None
    step = max(1, len(points) // tried)
    look = points[:: max(1, len(points) // 2048)]
    for v in points[::step][:tried]:
        d = distance(look, v)
        mu = int(np.median(d))
        if mu >= d.max():
            mu = int(d.max()) - 1
        near = int((d <= mu).sum())
        if 0 < near < len(d):
            score = float(d.std()) * min(near, len(d) - near) / len(d)
            if best is None or score > best[0]:
                best = (score, v, mu)
    return best and best[1:]


def grow(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, near, far) of the top tree; a child below zero is leaf -child-1."""
    nodes: list[list[int]] = []
    count = 0

    def build(points: np.ndarray, n: int) -> int:
        nonlocal count
        split = vantage(points) if n > 1 and len(points) > 3 else None
        if split is None:
            count += 1
            return -count
        v, mu = split
        d = distance(points, v)
        at = len(nodes)
        nodes.append([int(v), mu, 0, 0])
        near = d <= mu
        share = min(n - 1, max(1, round(n * near.mean())))
        nodes[at][2] = build(points[near], share)
        nodes[at][3] = build(points[~near], n - share)
        return at

    root = build(np.unique(sample), leaves)
    return [tuple(x) for x in nodes] if root >= 0 else []


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, fingerprints, whether they are its own or only queries)."""
    if not nodes:
        yield 0, fps, True
        return
    stack = [(0, fps, True)]
    while stack:
        at, x, own = stack.pop()
        if not len(x):
            continue
        if at < 0:
            yield -at - 1, x, own
            continue
        v, mu, near, far = nodes[at]
        d = distance(x, np.uint64(v)).astype(np.int16)
        if own:
            stack += [(near, x[d <= mu], True), (far, x[d > mu], True), (far, x[(d <= mu) & (d > mu - radius)], False)]
        else:
            stack += [(near, x[d <= mu + radius], False), (far, x[d > mu - radius], False)]


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[x], x):
        x = up
    return x


def join_leaf(points: np.ndarray, own: np.ndarray, queries: np.ndarray, radius: int, within: bool = True, base: int = 512) -> np.ndarray:
    """For each position another one that it is linked with, directly or not (itself if none): queries with
    own, and if `within`, own with own; prunes by vantage points of its own."""
    stack, parent = [(own, queries)], np.arange(len(points))
    while stack:
        p, q = stack.pop()
        split = vantage(points[p], 4) if len(p) > base else None
        if split is not None:
            v, mu = split
            dp, dq = distance(points[p], v).astype(np.int16), distance(points[q], v).astype(np.int16)
            near, far = dp <= mu, dp > mu
            reach = [q[dq > mu - radius], p[near & (dp > mu - radius)]] if within else [q[dq > mu - radius]]
            stack += [(p[near], q[dq <= mu + radius]), (p[far], np.concatenate(reach))]
            continue
        if within:
            q = np.concatenate([p, q])
        for i in range(0, len(q), base):
            for j in range(0, len(p), base):
                a, b = q[i : i + base], p[j : j + base]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius)
                x, y = _roots(parent, a[x]), _roots(parent, b[y])
                apart = x != y
                if apart.any():
                    nodes, at = np.unique(np.concatenate([x[apart], y[apart]]), return_inverse=True)
                    parent[nodes] = nodes[least_reachable(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))]
    return _roots(parent, np.arange(len(points)))


def _cell_links(radius: int):
    """(fp, root) of the points of a cell that have another within reach."""

    def run(cell: pa.Table) -> pa.Table:
        points = cell.column("fp").to_numpy().view(np.uint64)
        side, within = cell.column("side").to_numpy(), cell.column("within")[0].as_py()
        order = np.lexsort((points, side))
        points = points[order]
        n = int((side == 0).sum())
        root = join_leaf(points, np.arange(n), np.arange(n, len(points)), radius, within)
        linked = np.flatnonzero(points[root] != points)
        return pa.Table.from_arrays([pa.array(points[x].view(np.int64)) for x in (linked, root[linked])], names=["fp", "root"])

    return run


def cells(dealt: DataFrame, most: int = LEAF) -> DataFrame:
    """dealt (leaf, fp, own) by cell (leaf, a, b), with no cell much beyond twice `most` rows.

    A leaf's own points, and the queries sent to it, are dealt to blocks of about `most`. Own block a
    meets each query block, and each other own block, in a cell of its own; the cell with the first
    query block also compares the block with itself.
    """
    blocks = lambda n: F.ceil(n / F.lit(most)).cast("int")
    sizes = dealt.groupBy("leaf").agg(F.greatest(F.lit(1), blocks(F.sum(F.col("own").cast("long")))).alias("n_own"), F.greatest(F.lit(1), blocks(F.sum((~F.col("own")).cast("long")))).alias("n_asked"))
    # A row for each leaf, of which there is one to about `most` fingerprints.
    placed = dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("own"), F.col("n_own")).otherwise(F.col("n_asked"))).cast("int"))

    def cell(a: Column, b: Column, side: int) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"), (b == F.col("n_own")).alias("within"))

    def up_to(n: Column, make) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n), make)

    block, n_own = F.col("block"), F.col("n_own")
    own = F.concat(
        up_to(F.col("n_asked"), lambda k: cell(block, n_own + k, 0)),
        up_to(n_own - block - 1, lambda k: cell(block, block + 1 + k, 0)),
        up_to(block, lambda k: cell(k, block, 1)),
    )
    asked = up_to(n_own, lambda k: cell(k, n_own + block, 1))
    return placed.select("leaf", "fp", F.explode(F.when(F.col("own"), own).otherwise(asked)).alias("c")).select("leaf", "fp", "c.*")


def hamming_components(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for each of the n distinct fingerprints that has another within reach; root names its component."""
    spark = ready(distinct.sparkSession)
    leaves = max(min(MIN_LEAVES, n // 64), math.ceil(n / LEAF))
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(grow(sample, leaves))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, x, own in route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), tree.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), leaf, dtype=np.int32)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), own))], names=["leaf", "fp", "own"])

    dealt = cut(distinct.select("fp").mapInArrow(deal, "leaf int, fp long, own boolean"))
    links = cells(dealt).groupBy("leaf", "a", "b").applyInArrow(_cell_links(radius), "fp long, root long").coalesce(parts_for(dealt.count()))
    return connected_components(links, "fp", "root").select(F.col("node").alias("fp"), "root")


def print_components(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> tuple[DataFrame, int, int]:
    """(fp, component_id, copies) of the distinct fingerprints; how many these are, and how many rows."""
    # Counted rows bound what comes of them, so results are kept in no more parts than these rows need.
    most = prints.count()
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).coalesce(parts_for(most)))
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    n = size["n"]
    distinct = distinct.coalesce(parts_for(n))
    found = hamming_components(distinct, n, radius)
    joined = cut(distinct.join(maybe_broadcast(found, n, 64), "fp", "left").coalesce(parts_for(n)))
    members = joined.where("root is not null")
    lowest = cut(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")).coalesce(parts_for(n)))
    linked = lookup(members, lowest, "root", n, 64, "members", n)
    alone = joined.where("root is null").select("fp", F.col("first_id").alias("component_id"), "copies")
    return cut(linked.select("fp", "component_id", "copies").unionByName(alone).coalesce(parts_for(n))), n, size["rows"]


def components(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """prints (id_col, fp, ...) with component_id (replaced where prints has one): the smallest id reachable over fingerprints within radius."""
    prints = cut(prints.drop("component_id"))
    by_print, n, rows = print_components(prints, radius, id_col)
    return lookup(prints, by_print, "fp", n, 64, "copies", rows)


def query(docs: DataFrame) -> DataFrame:
    found = components(with_fingerprints(docs.select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
