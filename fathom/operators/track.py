"""Long tracks: as-of brackets, row numbers and row windows of one key over many tasks.

A key's rows are cut into chunks of some CHUNK_ROWS rows in the order of time. The cuts come from counts of narrow
cells of time, so that dense stretches get more chunks; rows of equal times are never parted, which is the
one bound on a chunk (a key may not have very many rows of one time). What a chunk must know of the others is one small row a
chunk: its count, and its first and last fixes. These are carried along by windows over the chunks, not over the rows.

Row windows (medians, lags, runs) use exact row numbers: a block of rows with as many from its neighbours as the window
reaches stands in one task, and only the block's own rows are kept.

Rows with a null time belong to no chunk: brackets give them none, and numbered() puts them first in a chunk of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.skew import lookup
from fathom.session import cut

CHUNK_ROWS, CELL_ROWS, BLOCK_ROWS = 50_000, 64, 50_000
CELL, CHUNK = "_cell", "_chunk"


def chunked(df: DataFrame, keys: list[str], time: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with _chunk, a number that grows with time within a key; null for a null time. df is written to the checkpoint folder
    first: it is read several times, and must not be made anew by each of several brackets on top of each other."""
    df = cut(df)
    t = F.col(time).cast("double")
    span = df.agg(F.min(t).alias("low"), F.max(t).alias("high"), F.count(t).alias("n")).first()
    if not span["n"]:
        return df.withColumn(CHUNK, F.lit(None).cast("long"))
    width = max((span["high"] - span["low"]) * min(CELL_ROWS, rows) / span["n"], 1e-9)
    celled = df.withColumn(CELL, F.floor((t - span["low"]) / width))
    w = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.where(F.col(CELL).isNotNull()).groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_rows"))
    # Cells of a key are few beside its rows; their running count decides the chunk.
    cells = cut(cells.withColumn(CHUNK, F.floor(F.coalesce(F.sum("_rows").over(w), F.lit(0)) / rows)).withColumn("_where", F.struct(*keys, CELL)).select("_where", CHUNK, "_rows"))
    placed = lookup(celled.withColumn("_where", F.struct(*keys, CELL)), cells, "_where", cells.count(), 64, "_rows", span["n"])
    return placed.drop("_where", CELL).select(*df.columns, CHUNK)


def bracket(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], order: list[str], max_gap: float | None, rows: int = CHUNK_ROWS) -> DataFrame:
    """As asof.bracket, with a key's rows over many tasks: probes with a and b, the fixes around each probe's time."""
    fix = F.struct(F.col(time).cast("double").alias("t"), *values)
    kind = fixes.select(fix.alias("f")).schema["f"].dataType
    orders = F.struct(*order)
    left = probes.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(None).cast(kind).alias("_fix"), F.lit(None).cast(fixes.select(orders.alias("o")).schema["o"].dataType).alias("_order"), F.struct(*probes.columns).alias("_probe"))
    right = fixes.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("_t"), fix.alias("_fix"), orders.alias("_order"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"))
    both = chunked(left.unionByName(right), keys, "_t", rows)
    is_fix = F.col("_fix").isNotNull()
    place = F.struct("_t", "_order")
    ends = both.where(is_fix).groupBy(*keys, CHUNK).agg(F.min_by("_fix", place).alias("_first"), F.max_by("_fix", place).alias("_last"))
    chunks = both.where(F.col(CHUNK).isNotNull()).select(*keys, CHUNK).distinct().join(ends, [*keys, CHUNK], "left")
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = chunks.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    held = both.join(carried.select(*keys, CHUNK, "_before", "_after"), [*keys, CHUNK], "left")
    inside = Window.partitionBy(*keys, CHUNK)
    ahead = inside.orderBy("_t", is_fix, "_order").rowsBetween(Window.unboundedPreceding, -1)
    back = inside.orderBy(F.desc("_t"), is_fix.desc(), F.desc("_order")).rowsBetween(Window.unboundedPreceding, -1)
    seen = held.withColumn("_a", F.coalesce(F.last("_fix", ignorenulls=True).over(ahead), "_before")).withColumn("_b", F.coalesce(F.last("_fix", ignorenulls=True).over(back), "_after"))
    # A fix with the one after it: a probe on the very first fix lies between these two, which are of its own time or later.
    seen = seen.withColumn("_pair", F.when(is_fix, F.struct(F.col("_b").alias("two")))).withColumn("_pair", F.last("_pair", ignorenulls=True).over(back))
    first = F.col("_a").isNull() & (F.col("_b.t") == F.col("_t"))
    a, b = F.when(first, F.col("_b")).otherwise(F.col("_a")), F.when(first, F.col("_pair.two")).otherwise(F.col("_b"))
    ok = (b["t"] - a["t"] > 0) & F.col("_t").isNotNull()
    if max_gap is not None:
        ok &= b["t"] - a["t"] <= max_gap
    return seen.where(F.col("_probe").isNotNull()).select("_probe.*", F.when(ok, a).alias("a"), F.when(ok, b).alias("b"))


def interpolate(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], order: list[str], max_gap: float | None, prefix: str = "at_", rows: int = CHUNK_ROWS) -> DataFrame:
    """As asof.interpolate, with a key's rows over many tasks."""
    from fathom.operators.asof import lerp

    joined = bracket(probes, fixes, keys, time, values, order, max_gap, rows)
    return joined.select(*probes.columns, *[lerp(F.col(time), v).alias(prefix + v) for v in values])


def numbered(df: DataFrame, keys: list[str], time: str, order: list[str], name: str = "n", rows: int = CHUNK_ROWS) -> DataFrame:
    """df with each row's number in its key from 0, by time (nulls first) and order."""
    placed = chunked(df, keys, time, rows).withColumn(CHUNK, F.coalesce(CHUNK, F.lit(-1)))
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_skip", F.coalesce(F.sum("_rows").over(w), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(time, *order)) - 1
    return placed.join(counts, [*keys, CHUNK]).withColumn(name, (inside + F.col("_skip")).cast("long")).drop(CHUNK, "_skip").select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], time: str, order: list[str], value: Column, name: str = "total", rows: int = CHUNK_ROWS) -> DataFrame:
    """df with the sum of a value over each row of its key and those before it, by time (nulls first) and order."""
    placed = chunked(df, keys, time, rows).withColumn(CHUNK, F.coalesce(CHUNK, F.lit(-1))).withColumn("_value", value)
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_sum")).withColumn("_skip", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy(*keys, CHUNK).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(sums, [*keys, CHUNK]).withColumn(name, inside + F.col("_skip")).select(*df.columns, name)


class Blocks:
    """Rows of numbered() in blocks, each with `half` rows more on either side; windows over a block's rows see what they would of the
    whole key, for frames of at most half rows to either side."""

    def __init__(self, df: DataFrame, keys: list[str], half: int, name: str = "n", rows: int = BLOCK_ROWS):
        self.keys, self.name, self.rows = keys, name, max(rows, half)
        block = lambda n: F.floor(n / self.rows)
        n = F.col(name)
        spots = F.array_distinct(F.array(block(n), F.greatest(block(n - half), F.lit(0)), block(n + half)))
        self.held = df.withColumn("_block", F.explode(spots))

    def over(self) -> Window:
        return Window.partitionBy(*self.keys, "_block").orderBy(self.name)

    def own(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("_block") == F.floor(F.col(self.name) / self.rows)).drop("_block")


def despike(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, half: int = 7, floor: float = 0.5, share: float = 0.25, rows: int = BLOCK_ROWS) -> DataFrame:
    """As robust.despike, with a key's rows over many tasks: rows within max(floor, share*median) of the rolling median."""
    blocks = Blocks(numbered(df, keys, time, order, "_n", rows), keys, half, "_n", rows)
    held = blocks.own(blocks.held.withColumn("_median", F.percentile(value, 0.5).over(blocks.over().rowsBetween(-half, half))))
    near = F.abs(F.col(value) - F.col("_median")) <= F.greatest(F.lit(floor), share * F.col("_median"))
    return held.where(near).select(*df.columns)


def sessionise(df: DataFrame, keys: list[str], time: str, order: list[str], breaks: Column, name: str = "session", rows: int = BLOCK_ROWS) -> DataFrame:
    """As session.sessionise, with a key's rows over many tasks: starts are told by each row and the one before it, and counted
    by block; the counts of the blocks before are added."""
    blocks = Blocks(numbered(df, keys, time, order, "_n", rows), keys, 1, "_n", rows)
    marked = blocks.held.withColumn("prev", F.lag(F.struct(*df.columns)).over(blocks.over()))
    starts = blocks.own(marked.withColumn("_start", F.when(F.col("prev").isNotNull() & breaks, 1).otherwise(0)).drop("prev"))
    placed = cut(starts.withColumn("_block", F.floor(F.col("_n") / blocks.rows)))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys, "_block").agg(F.sum("_start").alias("_starts")).withColumn("_skip", F.coalesce(F.sum("_starts").over(w), F.lit(0))).drop("_starts")
    inside = F.sum("_start").over(Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(before, [*keys, "_block"]).withColumn(name, inside + F.col("_skip")).select(*df.columns, name)
