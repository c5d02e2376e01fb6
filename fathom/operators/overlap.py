"""What points lie in intervals, told by ranks: no pair of an interval and a point is ever made but within one block of points.

The number of points in an interval is the difference of two ranks. The least value in it is that of three parts: the rest of the
block of points in which it begins, the start of the block in which it ends, and the whole blocks between, which two rows of a
table of doubling spans cover. So the work is in proportion to the intervals and the points, however long the intervals are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import track
from fathom.session import cut

BLOCK = 128


def overlap_summary(intervals: DataFrame, points: DataFrame, low: str, high: str, at: str, value: str, block: int = BLOCK, rows: int = track.CHUNK_ROWS) -> DataFrame:
    """intervals with n, how many points lie from low to high, ends included, and least, their least value; 0 and null for none.

    Points with a null place lie nowhere, intervals with a null end hold none; null values count in n only.
    """
    columns = intervals.columns
    held = cut(intervals.withColumn("_id", F.monotonically_increasing_id()))
    known = points.where(F.col(at).isNotNull()).select(F.lit(1).alias("_one"), F.col(at).cast("double").alias("_t"), F.col(value).alias("_v"))
    ends = held.select("_id", F.explode(F.array(F.struct(F.col(low).cast("double").alias("t"), F.lit(0).alias("kind")), F.struct(F.col(high).cast("double").alias("t"), F.lit(2).alias("kind")))).alias("e"))
    ends = ends.select(F.lit(1).alias("_one"), F.col("e.t").alias("_t"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.col("e.kind").alias("_kind"), "_id").where(F.col("_t").isNotNull())
    both = known.withColumn("_kind", F.lit(1)).withColumn("_id", F.lit(None).cast("long")).unionByName(ends)
    # At equal places a low end stands before the points, a high end behind them.
    ranked = cut(track.running_sum(both, ["_one"], "_t", ["_kind", "_v"], (F.col("_kind") == 1).cast("long"), "_rank", rows))
    spans = ranked.where(F.col("_kind") != 1).groupBy("_id").agg(F.max(F.when(F.col("_kind") == 0, F.col("_rank"))).alias("_from"), F.max(F.when(F.col("_kind") == 2, F.col("_rank"))).alias("_to"))
    spans = cut(spans.where(F.col("_to") > F.col("_from")))  # ranks _from to _to, end exclusive
    placed = cut(ranked.where("_kind = 1").select((F.col("_rank") - 1).alias("_rank"), F.floor((F.col("_rank") - 1) / block).alias("_block"), "_v"))
    w = Window.partitionBy("_block").orderBy("_rank")
    sides = placed.select("_rank", F.min("_v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_after"), F.min("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"))
    asked = spans.withColumn("_b0", F.floor(F.col("_from") / block)).withColumn("_b1", F.floor((F.col("_to") - 1) / block))
    wide, narrow = asked.where("_b1 > _b0"), asked.where("_b1 = _b0")
    heads = wide.join(sides.select(F.col("_rank").alias("_from"), F.col("_after").alias("_m")), "_from").select("_id", "_m")
    tails = wide.join(sides.select((F.col("_rank") + 1).alias("_to"), F.col("_before").alias("_m")), "_to").select("_id", "_m")
    whole = wide.where("_b1 - _b0 > 1").withColumn("_k", F.floor(F.log2(F.col("_b1") - F.col("_b0") - 1) + 1e-9).cast("int"))
    doubled = _doubling(placed.groupBy("_block").agg(F.min("_v").alias("_m")), whole.agg(F.max("_k")).first()[0])
    starts = F.array(F.col("_b0") + 1, F.col("_b1") - F.pow(F.lit(2), F.col("_k")).cast("long"))
    middles = whole.withColumn("_block", F.explode(starts)).join(doubled, ["_k", "_block"]).select("_id", "_m")
    inner = narrow.withColumnRenamed("_b0", "_block").join(placed, "_block").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select("_id", F.col("_v").alias("_m"))
    least = heads.unionByName(tails).unionByName(middles).unionByName(inner).groupBy("_id").agg(F.min("_m").alias("least"))
    counted = spans.select("_id", (F.col("_to") - F.col("_from")).alias("n")).join(least, "_id", "left")
    return held.join(counted, "_id", "left").select(*columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least")


def _doubling(blocks: DataFrame, levels: int | None) -> DataFrame:
    """(_k, _block, _m): the least value of the 2^_k blocks from _block on."""
    level = cut(blocks)
    found = level.withColumn("_k", F.lit(0))
    for k in range(levels or 0):
        later = level.select((F.col("_block") - (1 << k)).alias("_block"), F.col("_m").alias("_n"))
        level = cut(level.join(later, "_block").select("_block", _less("_m", "_n").alias("_m")))
        found = found.unionByName(level.withColumn("_k", F.lit(k + 1)))
    return found.select("_k", "_block", "_m")


def _less(a: str, b: str) -> Column:
    return F.least(a, b)  # passes nulls over
