"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups (equal texts) are packed in blocks of bounded size; each block deals its groups to
`shards` bundles, placing every group where the dot product of its demand with the residual
capacity is highest. The bundles of up to FANOUT blocks are then packed in the same way, until
one block is left, so that no task ever sees more than a few thousand items.

Nulls: a null text has size 1 (no bytes, plus 1) and is a group of its own. Repeated rows are
rows like others. A group stays on one shard unless it holds more than 1/WHOLE of a shard's bytes or rows, at any size of
the table; one that does is split into pieces of 1/PIECES of a shard by a hash of its rows, so that a text held by a third of
all rows still spreads evenly. Tokens are those of the vocabulary of `path`. Further columns of the input aren't returned.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import cut, maybe_broadcast, ready
from fathom.llm.packing import token_ids, vocabulary_path

BLOCK_GROUPS = 4096
FANOUT = 256
PIECES, WHOLE = 64, 4
#: How much an unevenness in bytes, tokens and rows counts; the first is the law that must hold.
WEIGHTS = (4.0, 1.0, 1.0)


def place(demand: np.ndarray, shards: int, turn: int = 0) -> np.ndarray:
    """The bundle of each item: largest first, to the highest dot product with the residual capacity."""
    total = demand.sum(axis=0)
    unit = demand / np.where(total > 0, total, 1) * np.sqrt(np.asarray(WEIGHTS))
    residual = np.tile(unit.sum(axis=0) / shards, (shards, 1))
    out = np.empty(len(unit), dtype=np.int32)
    for i in np.argsort(-unit.sum(axis=1), kind="stable"):
        best = int(np.argmax(residual @ unit[i]))
        residual[best] -= unit[i]
        out[i] = best
    return (out + turn) % shards


def _pack(keys: list[str], shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", *keys], ascending=False, kind="stable").reset_index(drop=True)
        turn = int(pdf["block"].iloc[0]) % shards
        bundle = place(pdf[["bytes", "tokens", "rows"]].to_numpy(dtype=np.float64), shards, turn)
        return pdf[["block", *keys, "bytes", "tokens", "rows"]].assign(bundle=bundle)

    return run


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot of every row; slots are gapless from 0 in each shard."""
    text, path = F.col(text_col), path or vocabulary_path()
    ready(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [len(ids) // 4 - 1 for ids in token_ids(b.column("text").to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(tokens, type=pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    base = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("row"),
            text.alias("text"),
        ).mapInArrow(counted, "doc_id long, size long, text_crc32 long, key long, row long, tokens long")
    )
    counts = base.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    share = F.greatest(F.col("bytes") / max(1, counts["size"] or 0), F.col("rows") / max(1, counts["n"]))
    pieces = F.when(share * shards * WHOLE > 1, F.least(F.ceil(share * shards * PIECES), F.col("rows"))).otherwise(1)
    # Each such group holds over 1/(shards*WHOLE) of the bytes or the rows: there are at most twice that many.
    hot = base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select("key", pieces.cast("int").alias("pieces")).where("pieces > 1")
    keyed = base.join(F.broadcast(hot), "key", "left").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(0).cast("int")
    )
    groups = cut(keyed.groupBy("key", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    n_groups = groups.count()
    blocks = max(1, math.ceil(n_groups / BLOCK_GROUPS))
    dealt = cut(
        groups.withColumn("block", F.pmod(F.xxhash64("key", "piece"), F.lit(blocks)).cast("long"))
        .groupBy("block")
        .applyInPandas(_pack(["key", "piece"], shards), "block long, key long, piece int, bytes long, tokens long, rows long, bundle int")
    )
    path = dealt.select("key", "piece", "block", "bundle", "rows")
    level = dealt
    while blocks > 1:
        rolled = level.groupBy("block", "bundle").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        up = math.ceil(blocks / FANOUT)
        level = cut(
            rolled.select(F.col("block").alias("was_block"), F.col("bundle").alias("was_bundle"), "bytes", "tokens", "rows")
            .withColumn("block", F.pmod("was_block", F.lit(up)).cast("long"))
            .groupBy("block")
            .applyInPandas(_pack(["was_block", "was_bundle"], shards), "block long, was_block long, was_bundle int, bytes long, tokens long, rows long, bundle int")
        )
        step = level.select(F.col("was_block").alias("block"), F.col("was_bundle").alias("bundle"), F.col("block").alias("to_block"), F.col("bundle").alias("to_bundle"))
        path = path.join(maybe_broadcast(step, blocks * shards, 32), ["block", "bundle"]).select(
            "key", "piece", F.col("to_block").alias("block"), F.col("to_bundle").alias("bundle"), "rows"
        )
        blocks = up
    placed = cut(keyed.join(path.select("key", "piece", F.col("bundle").alias("shard")), ["key", "piece"]).select("doc_id", "size", "text_crc32", "tokens", "row", "shard"))
    return placed.transform(lambda df: slots(df, counts["n"])).drop("row")


def slots(placed: DataFrame, rows: int, per_bucket: int = 2000) -> DataFrame:
    """Numbers the rows of each shard from 0: ranks in hash buckets of bounded size, plus the rows of the buckets before."""
    buckets = max(1, math.ceil(rows / 16 / per_bucket))
    rest = [c for c in placed.columns if c not in ("shard",)]
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*rest), F.lit(buckets)).cast("long"))
    before = (
        placed.groupBy("shard", "bucket")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*rest))
    return (
        placed.withColumn("rank", rank)
        .join(maybe_broadcast(before, 16 * buckets, 32), ["shard", "bucket"])
        .withColumn("slot", F.col("rank") + F.col("before") - 1)
        .drop("rank", "before", "bucket")
    )


def query(docs: DataFrame, shards: int = 16) -> DataFrame:
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
