"""Runs, gaps and distances along ordered rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sessionise(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "session") -> DataFrame:
    """df with a run number from 0 by key; breaks says, of a row and its `prev` struct, whether a run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("prev", F.lag(F.struct(*df.columns)).over(w))
    starts = F.when(F.col("prev").isNotNull() & breaks, 1).otherwise(0)
    return marked.withColumn("_start", starts).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("prev", "_start")


def steps(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "step") -> DataFrame:
    """df with the difference to the row before; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def cumulative(df: DataFrame, keys: list[str], order: list[str], step: Column, name: str = "along") -> DataFrame:
    """df with the running sum of a step that may refer to `prev`, the row before; nulls count as 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("prev", F.lag(F.struct(*df.columns)).over(w)).withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return marked.withColumn(name, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("prev", "_step")


def smooth_along(df: DataFrame, keys: list[str], order: list[str], time: str, along: str, span: int, name: str = "smooth") -> DataFrame:
    """df with the along-track distance integrated from the speed over span rows to either side; never falling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = w.rowsBetween(-span, span)
    dt = F.last(time).over(near) - F.first(time).over(near)
    speed = F.when(dt > 0, (F.last(along).over(near) - F.first(along).over(near)) / dt).otherwise(0.0)
    timed = df.withColumn("_speed", speed)
    part = F.greatest((F.col("_speed") + F.lag("_speed").over(w)) / 2 * (F.col(time) - F.lag(time).over(w)), F.lit(0.0))
    return timed.withColumn("_part", F.coalesce(part, F.lit(0.0))).withColumn(name, F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_speed", "_part")


def place_rows(df: DataFrame, keys: list[str], order: list[str], along: str, pitch: float, name: str = "row") -> DataFrame:
    """df with a row number of pitch metres: the next one, or farther after a gap of over 1.5 pitches."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(along) - F.lag(along).over(w)
    step = F.when(gap > 1.5 * pitch, F.floor(gap / pitch + 0.5)).otherwise(F.lit(1))
    placed = df.withColumn("_step", F.when(F.lag(along).over(w).isNull(), F.lit(0)).otherwise(step))
    return placed.withColumn(name, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_step")


def long_runs(df: DataFrame, keys: list[str], run: str, length: str, least: float) -> DataFrame:
    """Rows of the runs whose summed length reaches the least."""
    kept = df.groupBy(*keys, run).agg(F.sum(length).alias("_length")).where(F.col("_length") >= least).drop("_length")
    return df.join(kept, [*keys, run], "left_semi")


def fill_rows(df: DataFrame, keys: list[str], row: str, values: list[str], most: int = 5) -> DataFrame:
    """(keys, row, values): df's rows and, in gaps of 2 to `most` row numbers, rows interpolated between both sides."""
    w = Window.partitionBy(*keys).orderBy(row)
    after = df.select(*keys, row, *values, F.lead(F.struct(row, *values)).over(w).alias("_next"))
    gap = F.col(f"_next.{row}") - F.col(row)
    filled = F.when(gap.between(2, most), gap - 1).otherwise(0)
    each = after.withColumn("_gap", gap).withColumn("_k", F.explode(F.sequence(F.lit(0), filled.cast("int"))))
    share = F.when(F.col("_k") > 0, F.col("_k") / F.col("_gap")).otherwise(0.0)
    between = [F.when(F.col("_k") > 0, F.col(v) * (1 - share) + F.col(f"_next.{v}") * share).otherwise(F.col(v)).alias(v) for v in values]
    return each.select(*keys, (F.col(row) + F.col("_k")).alias(row), *between)


def blend_rows(df: DataFrame, keys: list[str], order: list[str], gap: Column, step: float, places: list[str], arrays: list[str], nearer: list[str], fits: Column) -> DataFrame:
    """(keys, share, places, arrays, nearer): rows between neighbours of a key where `fits` holds, every `step` of their `gap`.

    gap and fits may use a row's columns and those of the row before, `prev`. Places are interpolated; arrays element by element where both
    rows have one, else the one that there is; elements of `nearer` (labels, say) come from the nearer row, or the one that has them.
    The rows themselves are not repeated.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    both = df.select(*keys, *order, *places, *arrays, *nearer, F.lag(F.struct(*order, *places, *arrays, *nearer)).over(w).alias("prev")).withColumn("_gap", gap)
    both = both.where(F.col("prev").isNotNull() & (F.col("_gap") > step) & fits)
    each = both.withColumn("share", F.explode(F.transform(F.sequence(F.lit(1), F.ceil(F.col("_gap") / step).cast("int")), lambda k: k * step / F.col("_gap")))).where("share < 1")
    t = F.col("share")

    def element(c: str, pick: Callable[[Column, Column], Column]) -> Column:
        size = F.greatest(F.size(c), F.size(f"prev.{c}"))
        one = lambda i: pick(F.get(f"prev.{c}", i), F.get(c, i))
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), one)).otherwise(F.col(c)).alias(c)

    mixed = lambda a, b: F.coalesce(a + (b - a) * t, a, b)
    label = lambda a, b: F.when(t < 0.5, F.coalesce(a, b)).otherwise(F.coalesce(b, a))
    spots = [(F.col(f"prev.{p}") + (F.col(p) - F.col(f"prev.{p}")) * t).alias(p) for p in places]
    return each.select(*keys, "share", *spots, *[element(c, mixed) for c in arrays], *[element(c, label) for c in nearer])


def quantised(x: Column, scale: float = 110.0) -> Column:
    """A brightness from 0 to 255; null stays null."""
    return F.least(F.greatest(F.floor(x * scale + 0.5), F.lit(0)), F.lit(255)).cast("int")


def route_distance(samples: DataFrame, keys: list[str], order: list[str], x: str, y: str, step: float = 3.0, name: str = "along") -> DataFrame:
    """samples with the distance along the route, which only counts moves of `step` or more from the last counted place.

    Jitter doesn't add up that way. Where a sample counts depends on all before it, so a key's samples
    (thinned positions, a few numbers each) are walked in one task; keys run side by side.
    """
    schema = T.StructType([*samples.schema.fields, T.StructField(name, T.DoubleType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        px, py = (pdf[c].to_numpy(dtype=float) for c in (x, y))
        out, base, last = np.zeros(len(pdf)), 0.0, 0
        for i in range(1, len(pdf)):
            d = float(np.hypot(px[i] - px[last], py[i] - py[last]))
            if d >= step:
                base, last, d = base + d, i, 0.0
            out[i] = base + d
        return pdf.assign(**{name: np.maximum.accumulate(out)})

    return samples.groupBy(*keys).applyInPandas(walk, schema)


def stretch(placed: DataFrame, keys: list[str], time: str, along: str, length: float, centre: Column) -> DataFrame:
    """(keys, start, end, length): the times between which the route runs `length` metres around the sample nearest to
    the time `centre`; the stretch is moved inside the route, and is all of a shorter one."""
    total = placed.groupBy(*keys).agg(F.max(along).alias("_total"), F.min_by(along, F.struct(F.abs(F.col(time) - centre), time)).alias("_at"), F.count("*").alias("_n")).where("_n > 1")
    low, high = F.col("_at") - length / 2, F.col("_at") + length / 2
    total = total.withColumn("_high", F.when(low < 0, F.least(F.col("_total"), high - low)).otherwise(high)).withColumn("_low", F.greatest(low, F.lit(0.0)))
    over = F.greatest(F.col("_high") - F.col("_total"), F.lit(0.0))
    total = total.withColumn("_low", F.greatest(F.col("_low") - over, F.lit(0.0))).withColumn("_high", F.col("_high") - over)
    w = Window.partitionBy(*keys).orderBy(time)
    legs = placed.select(*keys, F.col(time).alias("_t1"), F.col(along).alias("_a1"), F.lag(time).over(w).alias("_t0"), F.lag(along).over(w).alias("_a0"), F.row_number().over(w).alias("_i")).where("_i > 1").join(total, keys)

    def at(d: str) -> Column:
        """The time at a distance: on the first leg that ends there or beyond, else on the last."""
        share = F.least(F.greatest((F.col(d) - F.col("_a0")) / F.greatest(F.col("_a1") - F.col("_a0"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
        t = F.col("_t0") + (F.col("_t1") - F.col("_t0")) * share
        return F.coalesce(F.min_by(t, F.when(F.col("_a1") >= F.col(d), F.col("_i"))), F.max_by(t, "_i"))

    return legs.groupBy(*keys).agg(at("_low").alias("start"), at("_high").alias("end"), F.first(F.col("_high") - F.col("_low")).alias("length"))


def neighbours(points: DataFrame, keys: list[str], time: str, at: Column, apart: float = 0.5) -> DataFrame:
    """(keys, before, after): the last point's time more than `apart` before a time, and the first more than that after it."""
    t = F.col(time)
    return points.groupBy(*keys).agg(F.max(F.when(t < at - apart, t)).alias("before"), F.min(F.when(t > at + apart, t)).alias("after"))
