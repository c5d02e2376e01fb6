"""Near copies: SimHash groups, completed by verified word-shingle similarity.

Fingerprints within three bits (see simhash) only catch copies that differ a little. A pair whose
Jaccard similarity over five-word shingles is 0.8 commonly differs in five to twelve of 64 bits,
a radius at which a vantage-point tree cannot prune. So this stage joins to the SimHash groups the
pairs that agree in one of BANDS bands of ROWS minhashes and whose similarity reaches `similarity`:
the SKETCH lowest shingle hashes decide where they are clear, and whole texts where they aren't.

Equal word sequences meet in one row first. In a first round each member of a band bucket meets
the member with the lowest id and one drawn by a hash, so that a bucket with a third of all rows
makes rows in proportion; hot keys are broadcast, others shuffled. Links are contracted over the
SimHash components, not over documents. Then every other pair of a bucket whose members are still
in different groups is compared, block by block; of buckets with the same members one is taken.
The members of a bucket's largest group meet only those outside it, so the work is members times
members outside that group, and of a cell only the groups that it joins come back.

A null or empty text has no shingles; such texts form one group by their zero fingerprints, and
texts of fewer than five words are compared as whole sequences. A very long text is read in blocks
of shingles. Rows with a null id are all kept. Of repeated rows with one id, one stays; which one of
rows that differ beside the id isn't fixed. Ties go to the smallest id. An empty table gives an empty
result. All columns of docs are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import BROADCAST_BYTES, connected_components, cut, join_with_hot_keys, least_reachable, lookup, maybe_broadcast, parts_for, ready
from fathom.llm.simhash import FOLD, fingerprint, hashes, print_components, shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Lowest shingle hashes that are kept of a text; texts of fewer are compared exactly.
SKETCH = 1024
#: Estimates within this of the limit are settled by the whole texts; it is four standard errors.
NEAR = 0.05
#: Members of a bucket that are compared with as many others at a time, and sketch values of one product.
BLOCK, COLUMNS = 1024, 4096
#: Narrow rows that a member of an open bucket stands for when tasks are dealt.
CELL_WORK = 16
#: Narrow rows that a row with a sketch stands for.
SKETCHED = 16
#: Texts that a worker holds as Python objects at a time.
SLICE = 128
_RANDOM = np.random.default_rng(20240229)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sketch(text: str | None, k: int = SHINGLE) -> tuple[int, bytes, list[int]]:
    """The number of distinct shingles, the lowest of their hashes, and the band keys (none without shingles)."""
    lowest = [hashes(part).astype(np.uint64) for part in shingles(text, k)]
    if not lowest:
        return 0, b"", []
    h = np.unique(np.concatenate(lowest))
    mins = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        mins = np.minimum(mins, (h[None, at : at + 4096] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]).min(axis=1))
    bands = [xxhash.xxh64_intdigest(mins[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)]
    low = np.unique((h >> np.uint64(32)).astype("<u4"))[:SKETCH]
    return len(h), low.tobytes(), [b - (1 << 64) if b >> 63 else b for b in bands]


def top(low: np.ndarray) -> int:
    """The value up to which a sketch has all of its text's hashes."""
    return int(low[-1]) if len(low) >= SKETCH else 1 << 32


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sketches, over the values up to which both are whole."""
    x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
    limit = min(top(x), top(y))
    x, y = x[: np.searchsorted(x, limit, "right")], y[: np.searchsorted(y, limit, "right")]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


PRINT = "doc_id long, fp long, content long, n long, sketch binary, bands array<long>"


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One narrow pass over the texts: SimHash, content hash, size, sketch and bands."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = b.column(1).to_pylist()
            made = [sketch(t, k) for t in texts]
            contents = [xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").translate(FOLD).split()) if t else b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([fingerprint(t) for t in texts], type=pa.int64()),
                    pa.array([c - (1 << 64) if c >> 63 else c for c in contents], type=pa.int64()),
                    pa.array([m[0] for m in made], type=pa.int64()),
                    pa.array([m[1] for m in made], type=pa.binary()),
                    pa.array([m[2] for m in made], type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "fp", "content", "n", "sketch", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, PRINT)


def all_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a whole text."""
    parts = [hashes(part) for part in shingles(text, k)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def jaccard(a: str | None, b: str | None, k: int = SHINGLE) -> float:
    """Jaccard similarity over the distinct shingles of whole texts (their 64-bit hashes)."""
    x, y = all_hashes(a, k), all_hashes(b, k)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def first_pairs(narrow: DataFrame, rows: int, similarity: float) -> DataFrame:
    """(id, part, other, other_part): each content with at most two others of each of its band buckets,
    of similar size and another component."""
    in_band = narrow.select("id", "n", "part", F.explode("bands").alias("band"))
    one = F.struct("id", "n", "part")
    buckets = cut(in_band.groupBy("band").agg(F.count("*").alias("members"), F.min(one).alias("first"), F.min(F.struct(F.xxhash64("id", "band").alias("h"), one.alias("of"))).alias("drawn")).where("members > 1").coalesce(parts_for(rows * BANDS)))
    found = buckets.count()
    buckets = buckets.select("band", "members", F.array("first", "drawn.of").alias("partners")).coalesce(parts_for(found))
    placed = lookup(in_band, buckets, "band", found, 160, "members", rows * BANDS)
    met = placed.where("partners is not null").select("id", "n", "part", F.explode("partners").alias("p"))
    fit = (F.col("id") != F.col("p.id")) & (F.col("part") != F.col("p.part")) & (F.least("n", "p.n") >= similarity * F.greatest("n", "p.n"))
    return cut(met.where(fit).select("id", "part", F.col("p.id").alias("other"), F.col("p.part").alias("other_part")).distinct().coalesce(parts_for(rows * BANDS)))


def sketches_of(distinct: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """(id, sketch) of the asked ids only: sketches are what is large here, so the rest isn't shuffled."""
    asked = cut(ids.distinct().coalesce(parts_for(rows)))
    return distinct.select("id", "sketch").join(maybe_broadcast(asked, asked.count(), 16), "id", "left_semi")


def first_links(distinct: DataFrame, narrow: DataFrame, rows: int, similarity: float) -> DataFrame:
    """(a, b): components joined by first pairs that their sketches show to be similar enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = [(x.as_py(), y.as_py()) for x, y in zip(b.column("sketch"), b.column("other_sketch"))]
            sure = [likeness(x, y) >= similarity + NEAR * (max(len(x), len(y)) >= 4 * SKETCH) for x, y in sketches]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("other_part")], names=["a", "b"]).filter(pa.array(sure, type=pa.bool_()))

    pairs = first_pairs(narrow, rows, similarity)
    found = pairs.count()
    pairs = pairs.coalesce(parts_for(found))
    held = sketches_of(distinct, pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))), rows)
    # A bucket's first member may be the partner of very many; its few sketches are broadcast.
    others = held.withColumnsRenamed({"id": "other", "sketch": "other_sketch"}).join(pairs.groupBy("other").agg(F.count("*").alias("pairs")), "other")
    both = join_with_hot_keys(pairs, others, "other", "pairs", found).join(held, "id")
    return both.select("part", "other_part", "sketch", "other_sketch").mapInArrow(judge, "a long, b long").coalesce(parts_for(SKETCHED * found))


def common_values(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each sketch of a has in common with each of b."""
    va, vb = (np.concatenate(x) if x else np.empty(0, dtype="<u4") for x in (a, b))
    ra, rb = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    values = np.intersect1d(va, vb)
    if a is b:  # a value of one sketch alone is common to none
        values, times = np.unique(va, return_counts=True)
        values = values[times > 1]
    found = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(values), COLUMNS):
        some = values[at : at + COLUMNS]
        has = []
        for v, r, n in ((va, ra, len(a)), (vb, rb, len(b))):
            place = np.searchsorted(some, v).clip(max=len(some) - 1)
            held = some[place] == v
            m = np.zeros((n, len(some)), dtype=np.float32)
            m[r[held], place[held]] = 1
            has.append(m)
        found += has[0] @ has[1].T
    return found


def _compare_cell(similarity: float):
    """Compares the two blocks of a cell: (a, b) are groups that sketches join, (a, b, id, other) pairs that they leave open."""

    def run(cell: pa.Table) -> pa.Table:
        ids, n, group, block = (cell.column(c).to_numpy() for c in ("id", "n", "part", "block"))
        low = [np.frombuffer(s.as_py(), dtype="<u4") for s in cell.column("sketch")]
        tops = np.array([top(x) for x in low])
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lx = [low[k] for k in x]
        ly = lx if i == j else [low[k] for k in y]
        common = common_values(lx, ly)
        # How many values of a sketch lie in the range in which both are whole.
        nx = np.stack([np.searchsorted(v, np.minimum(tops[y], t), "right") for v, t in zip(lx, tops[x])])
        ny = np.stack([np.searchsorted(v, np.minimum(tops[x], t), "right") for v, t in zip(ly, tops[y])], axis=1)
        share = common / np.maximum(1, nx + ny - common)
        whole = (tops[x][:, None] >> 32 & tops[y][None, :] >> 32) == 1
        fit = (np.minimum(n[x][:, None], n[y][None, :]) >= similarity * np.maximum(n[x][:, None], n[y][None, :])) & (group[x][:, None] != group[y][None, :])
        if i == j:
            fit &= x[:, None] < y[None, :]
        groups, at = np.unique(group, return_inverse=True)
        p, q = np.nonzero(fit & (share >= similarity + NEAR * ~whole))
        root = least_reachable(at[x[p]], at[y[q]], len(groups))
        joined = np.flatnonzero(root != np.arange(len(groups)))
        p, q = np.nonzero(fit & ~whole & (share >= similarity - NEAR) & (share < similarity + NEAR) & (root[at[x]][:, None] != root[at[y]][None, :]))
        none = np.full(len(joined), None)
        columns = ((groups[joined], group[x[p]]), (groups[root[joined]], group[y[q]]), (none, ids[x[p]]), (none, ids[y[q]]))
        return pa.Table.from_arrays([pa.array([*some, *more], type=pa.int64()) for some, more in columns], names=["a", "b", "id", "other"])

    return run


def remaining_links(distinct: DataFrame, narrow: DataFrame, moved: DataFrame, rows: int, similarity: float) -> DataFrame:
    """Of all pairs that share a bucket and lie in different groups: (a, b) for groups that sketches join,
    (a, b, id, other) for pairs that only whole texts can settle."""
    now = lookup_groups(narrow, moved, rows)
    in_band = cut(now.select("id", "n", "part", F.explode("bands").alias("band"))).coalesce(parts_for(rows * BANDS))
    h = F.xxhash64("id")
    # Buckets of one group need nothing. Of buckets with the same members one is enough.
    mixed = in_band.groupBy("band").agg(
        F.count("*").alias("members"), F.min("part").alias("low"), F.max("part").alias("high"), F.struct(F.count("*"), F.min("id"), F.max("id"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).alias("same")
    ).where("low <> high")
    mixed = cut(mixed.groupBy("same").agg(F.min(F.struct("band", "members")).alias("of")).select("of.band", "of.members", F.lit(True).alias("open")).coalesce(parts_for(rows * BANDS)))
    found = mixed.count()
    mixed = mixed.coalesce(parts_for(found))
    open_ = cut(lookup(in_band, mixed, "band", found, 64, "members", rows * BANDS).where("open").drop("open"))
    left = open_.count()
    open_ = open_.coalesce(parts_for(left))
    # The members of a bucket's largest group meet only those outside it.
    counts = open_.groupBy("band", "part").agg(F.count("*").alias("held"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    buckets = counts.groupBy("band").agg(F.sum("held").alias("members"), F.max(F.struct("held", "part")).alias("big"))
    buckets = cut(buckets.select("band", "members", F.col("big.part").alias("big"), blocks(F.col("members") - F.col("big.held")).alias("few"), blocks(F.col("big.held")).alias("many")).coalesce(parts_for(left)))
    placed = lookup(open_, buckets.coalesce(parts_for(found)), "band", found, 96, "members", left)
    outside = F.col("part") != F.col("big")
    spread = F.xxhash64("id", "band")
    placed = placed.withColumn("block", F.when(outside, F.pmod(spread, F.col("few"))).otherwise(F.col("few") + F.pmod(spread, F.col("many"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    sketched = placed.select("id", "n", "part", "band", "block", meets.alias("meets")).join(sketches_of(distinct, open_.select("id"), rows), "id")
    celled = sketched.select("id", "n", "part", "band", "block", "sketch", F.explode("meets").alias("with")).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    return cut(celled.drop("with").groupBy("band", "i", "j").applyInArrow(_compare_cell(similarity), "a long, b long, id long, other long").coalesce(parts_for(CELL_WORK * left)))


def settled_by_texts(doubtful: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, id, other) whose whole texts are similar enough; texts has (id, text).

    The texts are joined by sort-merge, so that Spark splits the pairs of an id that has very many.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [jaccard(x.as_py(), y.as_py()) >= similarity for x, y in zip(b.column("text"), b.column("other_text"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(same, type=pa.bool_()))

    asked = doubtful.select("id").unionByName(doubtful.select(F.col("other").alias("id"))).distinct()
    held = texts.join(asked, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")).hint("merge")
    both = doubtful.join(held, "id").join(held.withColumnsRenamed({"id": "other", "text": "other_text"}), "other")
    return both.select("a", "b", "text", "other_text").mapInArrow(compare, "a long, b long")


def lookup_groups(df: DataFrame, moved: DataFrame, total: int, name: str = "part") -> DataFrame:
    """df with the groups in `name` after the moves (node, root)."""
    moves = moved.select(F.col("node").alias(name), F.col("root").alias("_root"))
    sized = df.groupBy(name).agg(F.count("*").alias("_rows"))
    n = moved.count()
    small = n * 64 <= BROADCAST_BYTES
    held = moves.withColumn("_rows", F.lit(1)) if small else moves.join(sized, name)
    return lookup(df, held, name, n, 64, "_rows", total).withColumn(name, F.coalesce("_root", name)).drop("_root")


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id): the smallest id reachable over SimHash links and similar pairs."""
    seen = cut(prints(docs, id_col, text_col).where("doc_id is not null"))
    rows = seen.count()
    seen = seen.coalesce(parts_for(rows))
    by_print, n, _ = print_components(seen.select("doc_id", "fp"))
    by_print = by_print.coalesce(parts_for(n)).withColumnRenamed("component_id", "part")
    placed = lookup(seen.select("doc_id", "fp"), by_print, "fp", n, 64, "copies", rows).select("doc_id", "part")
    once = seen.where("n > 0").groupBy("content").agg(*[F.min_by(c, "doc_id").alias(c) for c in ("doc_id", "fp", "n", "sketch", "bands")])
    distinct = cut(once.withColumnRenamed("doc_id", "id").drop("content").coalesce(parts_for(SKETCHED * rows)))
    narrow = cut(lookup(distinct.select("id", "fp", "n", "bands").coalesce(parts_for(4 * rows)), by_print, "fp", n, 64, "copies", rows).select("id", "n", "bands", "part").coalesce(parts_for(4 * rows)))
    moved = cut(connected_components(first_links(distinct, narrow, rows, similarity)))
    rest = remaining_links(distinct, narrow, moved, rows, similarity)
    sure = rest.where("id is null").select("a", "b")
    held = moved.select(F.col("node").alias("a"), F.col("root").alias("b"))
    doubtful = rest.where("id is not null")
    if not rest.isEmpty():
        moved = cut(connected_components(held.unionByName(sure)))
        held = moved.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not doubtful.isEmpty():
        across = lookup_groups(lookup_groups(doubtful, moved, rows, "a"), moved, rows, "b").where("a <> b").distinct()
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        moved = cut(connected_components(held.unionByName(settled_by_texts(cut(across), texts, similarity))))
    return lookup_groups(placed, moved, rows).select("doc_id", F.col("part").alias("group_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest id."""
    groups = cut(near_duplicate_groups(docs, similarity, id_col, text_col))
    groups = groups.coalesce(parts_for(groups.count()))
    extra = groups.where("doc_id <> group_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(maybe_broadcast(extra, extra.count(), 16), id_col, "left_anti")
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
