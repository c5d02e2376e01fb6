"""As-of joins: brackets, interpolation, fallbacks, nearest neighbours and clock alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import distance_m
from fathom.operators.nearest import nearest


def bracket(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], order: list[str], max_gap: float | None) -> DataFrame:
    """probes with a and b, the fixes around each probe's time, as structs (t, values); null where none bracket it.

    a.t < time <= b.t; a probe exactly on the first fix lies between the first two. A bracket
    longer than max_gap counts as none. Both sides meet in one sort by key and time: one shuffle,
    and no task sees more than a key's rows. `order` breaks ties among fixes with equal times.
    """
    fix = F.struct(F.col(time).cast("double").alias("t"), *values)
    left = probes.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.struct(*[F.lit(None).cast(dict(fixes.dtypes)[o]).alias(o) for o in order]).alias("_order"), F.lit(None).cast(fixes.select(fix.alias("f")).schema["f"].dataType).alias("_fix"), F.struct(*probes.columns).alias("_probe"))
    right = fixes.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.struct(*order).alias("_order"), fix.alias("_fix"), F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType).alias("_probe"))
    both = left.unionByName(right)
    ahead = Window.partitionBy(*keys).orderBy("_t", "_kind", "_order").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_order")).rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        both.withColumn("_a", F.last("_fix", ignorenulls=True).over(ahead))
        .withColumn("_b", F.last("_fix", ignorenulls=True).over(back))
        .withColumn("_pair", F.when(F.col("_kind") == 1, F.struct(F.col("_fix").alias("one"), F.col("_b").alias("two"))))
        .withColumn("_pair", F.last("_pair", ignorenulls=True).over(back))
    )
    first = F.col("_a").isNull() & (F.col("_b.t") == F.col("_t"))
    a = F.when(first, F.col("_b")).otherwise(F.col("_a"))
    b = F.when(first, F.col("_pair.two")).otherwise(F.col("_b"))
    gap = b["t"] - a["t"]
    ok = gap > 0
    if max_gap is not None:
        ok &= gap <= max_gap
    out = seen.where("_kind = 0").select("_probe.*", F.when(ok, a).alias("a"), F.when(ok, b).alias("b"))
    return out


def lerp(time: Column, value: str) -> Column:
    """The bracket's value at a time; null without a bracket."""
    w = (time.cast("double") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return F.col(f"a.{value}") + (F.col(f"b.{value}") - F.col(f"a.{value}")) * w


def interpolate(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], order: list[str], max_gap: float | None, prefix: str = "at_") -> DataFrame:
    """probes with each value interpolated between the bracketing fixes."""
    joined = bracket(probes, fixes, keys, time, values, order, max_gap)
    return joined.select(*probes.columns, *[lerp(F.col(time), v).alias(prefix + v) for v in values])


def with_fallback(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, value: str, own: str, order: list[str], max_gap: float | None) -> DataFrame:
    """probes with the interpolated value, or else the row's own."""
    got = interpolate(probes, fixes, keys, time, [value], order, max_gap)
    return got.withColumn("resolved", F.coalesce(f"at_{value}", own)).drop(f"at_{value}")


def resolve(first: Column, second: Column, difference: Column, most: float) -> tuple[Column, Column]:
    """(value, source) of two sources: the first where both exist and agree within `most`, else the second, else missing."""
    use = F.coalesce(first.isNotNull() & (second.isNull() | (difference <= most)), F.lit(False))
    value = F.when(use & second.isNotNull(), first).otherwise(second)
    source = F.when(use & second.isNotNull(), "first").when(second.isNotNull(), "second").otherwise("missing")
    return value, source


def nearest_in_time(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], order: list[str]) -> DataFrame:
    """probes with near, the fix of the least time difference; the earlier one wins ties."""
    fix = F.struct(F.col(time).cast("double").alias("t"), *order, *[v for v in values if v not in order])
    left = probes.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(fixes.select(fix.alias("f")).schema["f"].dataType).alias("_fix"), F.struct(*probes.columns).alias("_probe"))
    right = fixes.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_kind"), fix.alias("_fix"), F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType).alias("_probe"))
    both = left.unionByName(right)
    # Of fixes with equal times the first by order must come last in either direction.
    before = Window.partitionBy(*keys).orderBy("_t", "_kind", F.desc("_fix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_kind", F.desc("_fix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_a", F.last("_fix", ignorenulls=True).over(before)).withColumn("_b", F.last("_fix", ignorenulls=True).over(after))
    da, db = F.col("_t") - F.col("_a.t"), F.col("_b.t") - F.col("_t")
    near = F.when(F.col("_a").isNull() | (db < da), F.col("_b")).otherwise(F.col("_a"))
    return seen.where("_kind = 1").select("_probe.*", near.alias("near"))


def nearest_point(probes: DataFrame, points: DataFrame, probe_xy: tuple[str, str], point_xy: tuple[str, str], order: str, cell: float, reach: int, itself: str | None = None) -> DataFrame:
    """probes with near (order, x, y, d2): the nearest point within reach*cell, null where there is none; see nearest.nearest."""
    return nearest(probes, points, probe_xy, point_xy, order, reach * cell, itself)


def score_offsets(samples: DataFrame, track: DataFrame, keys: list[str], offsets: Column, max_gap: float = 2.0) -> DataFrame:
    """(keys, offset, coverage, p50, p90, score) of each clock offset, lower being better.

    samples (keys, t, lon, lat, lat0) are probed at t + offset, for each number of the array
    `offsets`, against the segments of track (keys, t, lon, lat, ordinal). A segment spans at most
    max_gap seconds and is spread over the whole seconds it touches, so that probes meet segments
    in an equi-join on the second. Offsets that cover less than 0.7 of the samples have no score.
    """
    order = Window.partitionBy(*keys).orderBy("t", "ordinal")
    segments = (
        track.select(*keys, "t", "lon", "lat", *[F.lag(c).over(order).alias(f"{c}_0") for c in ("t", "lon", "lat")], F.row_number().over(order).alias("n"))
        .where((F.col("t") > F.col("t_0")) & (F.col("t") - F.col("t_0") <= max_gap))
        .withColumn("second", F.explode(F.sequence(F.floor("t_0"), F.floor("t"))))
    )
    n = F.count("*").over(Window.partitionBy(*keys)).alias("samples")
    probes = (
        samples.select(*keys, F.col("t").alias("st"), F.col("lon").alias("slon"), F.col("lat").alias("slat"), "lat0", n, offsets.alias("_offsets"))
        .withColumn("offset", F.explode("_offsets")).withColumn("at", F.col("st") + F.col("offset")).withColumn("second", F.floor("at"))
    )
    w = (F.col("at") - F.col("t_0")) / (F.col("t") - F.col("t_0"))
    lon, lat = F.col("lon_0") + (F.col("lon") - F.col("lon_0")) * w, F.col("lat_0") + (F.col("lat") - F.col("lat_0")) * w
    hit = (F.col("at") <= F.col("t")) & ((F.col("at") > F.col("t_0")) | ((F.col("n") == 2) & (F.col("at") == F.col("t_0"))))
    errors = probes.join(segments, [*keys, "second"]).where(hit).select(*keys, "offset", "samples", distance_m(F.col("slon"), F.col("slat"), lon, lat, F.col("lat0")).alias("error"))
    scored = errors.groupBy(*keys, "offset").agg((F.count("*") / F.max("samples")).alias("coverage"), F.percentile("error", 0.5).alias("p50"), F.percentile("error", 0.9).alias("p90"))
    score = F.when(F.col("coverage") >= 0.7, F.col("p50") + 0.3 * F.col("p90") + 100 * (1 - F.col("coverage")))
    return scored.withColumn("score", score)


def best_offset(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the least score of each key, the earliest offset among equals."""
    names = [c for c in scored.columns if c not in keys]
    return scored.where("score is not null").groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("score", "offset")).alias("best")).select(*keys, "best.*")


def nearest_anywhere(probes: DataFrame, points: DataFrame, probe_xy: tuple[str, str], point_xy: tuple[str, str], order: str, cell: float | None = None, itself: str | None = None) -> DataFrame:
    """probes with near (order, x, y, d2): the nearest point however far; null only without points. Cells follow the points, so
    that `cell`, once the width of the first ones, has no effect; it stays for its callers."""
    return nearest(probes, points, probe_xy, point_xy, order, itself=itself)
