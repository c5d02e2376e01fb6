"""The nearest of many points on a plane, by cells that are divided until each holds few points.

Probes go down from the one cell of all points. A cell stands for its points by their box: from box and probe follow the least
and the greatest distance that any of the points can have. At each step a probe keeps the cells that may still hold its nearest
point, and only these are divided, so it meets a few cells at each depth and a few leaves at the end, however dense or
far the points are. The distances of boxes are computed as those of points are, so rounding never hides one that is as near.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.geo import finite
from fathom.operators.skew import maybe_broadcast
from fathom.session import cut

#: Points of a cell that isn't divided; binary digits by which a cell is divided on each axis; digits of the finest cells.
LEAF, BITS, DIGITS = 32, 2, 50
#: A generous width of a row of cells or points, for broadcasts.
ROW_BYTES = 128


def counted(probes: DataFrame) -> DataFrame:
    """Each distinct probe, its columns again as the struct _probe, and in _times how many rows it has."""
    return probes.groupBy(*probes.columns).agg(F.count("*").alias("_times")).withColumn("_probe", F.struct(*probes.columns))


def repeats() -> Column:
    """To be exploded: once for each of the rows that counted() has merged."""
    return F.sequence(F.lit(1).cast("long"), F.col("_times"))


def _d2(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _places(points: DataFrame, xy: tuple[str, str], order: str, itself: bool) -> DataFrame:
    """(order, x, y): of each place the least order, and the next one where a probe may pass over itself."""
    held = points.select(F.col(order).alias("order"), *[finite(F.col(c)).alias(n) for c, n in zip(xy, "xy")]).where("x is not null and y is not null")
    held = held.distinct() if itself else held
    # Spark limits each part to these first rows before it shuffles: a place of very many points is no burden.
    return held.withColumn("_k", F.row_number().over(Window.partitionBy("x", "y").orderBy("order"))).where(F.col("_k") <= (2 if itself else 1)).drop("_k")


def _cells(rows: DataFrame, shift: int) -> DataFrame:
    """(_ci, _cj, n, box, least and greatest order, _need): the cells of rows (order, x, y, _i, _j) without the last `shift`
    digits; _need is how many digits differ within a cell."""
    ends = [f(c).alias(f"_{n}{c.strip('_')}") for c in ("x", "y", "order", "_i", "_j") for f, n in ((F.min, "min_"), (F.max, "max_"))]
    cells = rows.groupBy(F.shiftright("_i", shift).alias("_ci"), F.shiftright("_j", shift).alias("_cj")).agg(F.count(F.lit(1)).alias("_n"), *ends)
    apart = F.col("_min_i").bitwiseXOR(F.col("_max_i")).bitwiseOR(F.col("_min_j").bitwiseXOR(F.col("_max_j")))
    return cells.withColumn("_need", F.when(apart > 0, F.length(F.bin(apart))).otherwise(0)).drop("_min_i", "_max_i", "_min_j", "_max_j")


def _possible(found: DataFrame, itself: bool) -> DataFrame:
    """found, probes with cells, without the cells that can't hold the nearest point; _bound is what the nearest can't exceed."""
    least = _d2(F.greatest(F.col("_min_x") - F.col("_px"), F.col("_px") - F.col("_max_x"), F.lit(0.0)), F.greatest(F.col("_min_y") - F.col("_py"), F.col("_py") - F.col("_max_y"), F.lit(0.0)))
    most = _d2(F.greatest(F.abs(F.col("_px") - F.col("_min_x")), F.abs(F.col("_px") - F.col("_max_x"))), F.greatest(F.abs(F.col("_py") - F.col("_min_y")), F.abs(F.col("_py") - F.col("_max_y"))))
    if itself:
        found = found.where((F.col("_min_order") != F.col("_self")) | (F.col("_max_order") != F.col("_self")))
    found = found.withColumn("_least", least).where(F.col("_least") <= F.col("_bound"))
    bound = F.least("_bound", F.min(most).over(Window.partitionBy("_pid")))
    return found.withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound")).drop("_min_x", "_max_x", "_min_y", "_max_y", "_min_order", "_max_order")


def nearest(probes: DataFrame, points: DataFrame, probe_xy: tuple[str, str], point_xy: tuple[str, str], order: str, within: float = float("inf"), itself: str | None = None, leaf: int = LEAF) -> DataFrame:
    """probes with near (order, x, y, d2): the nearest point, the least order among equals, or null where none is `within` that
    distance. Equal probes are asked once and come back as often as they were. Where `itself` names a column of probes, points
    whose order equals it are passed over. Probes and points without finite places are near to nothing."""
    asked = cut(counted(probes).select("_probe", "_times", F.monotonically_increasing_id().alias("_pid")))
    rows = cut(_places(points, point_xy, order, itself is not None))
    shape = T.StructType([T.StructField("order", rows.schema["order"].dataType), *[T.StructField(n, T.DoubleType()) for n in ("x", "y", "d2")]])
    span = rows.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "low"), (F.max, "high"))], F.count("*").alias("n")).first()
    again = F.explode(repeats()).alias("_copy")
    if not span["n"]:
        return asked.select("_probe.*", F.lit(None).cast(shape).alias("near"), again).drop("_copy")
    width = max(span["high_x"] - span["low_x"], span["high_y"] - span["low_y"]) or 1.0
    place = [F.least(F.floor((F.col(c) - span[f"low_{c}"]) / width * float(1 << DIGITS)), F.lit((1 << DIGITS) - 1)).alias(d) for c, d in (("x", "_i"), ("y", "_j"))]
    rows = rows.select("*", *place)
    own = [F.col(f"_probe.{itself}").alias("_self")] if itself else []
    xy = [finite(F.col(f"_probe.{c}")).alias(n) for c, n in zip(probe_xy, ("_px", "_py"))]
    open_ = asked.select("_pid", *xy, *own, F.lit(within**2).alias("_bound")).where("_px is not null and _py is not null")
    open_ = open_.withColumn("_ci", F.lit(0).cast("long")).withColumn("_cj", F.lit(0).cast("long"))
    shift, step, leaves, held = DIGITS, 0, [], []
    while True:
        cells = cut(_cells(rows, shift))
        told = cells.agg(F.count("*").alias("n"), F.max(F.when((F.col("_n") > leaf) & (F.col("_need") > 0), F.col("_need"))).alias("need")).first()
        divided = (F.col("_n") > leaf) & (F.col("_need") > 0)
        parents = cells.select("*", F.shiftright("_ci", step).alias("_pi"), F.shiftright("_cj", step).alias("_pj"))
        found = open_.withColumnsRenamed({"_ci": "_pi", "_cj": "_pj"}).join(maybe_broadcast(parents, told["n"], ROW_BYTES), ["_pi", "_pj"]).drop("_pi", "_pj")
        found = cut(_possible(found, itself is not None).withColumn("_divided", divided).drop("_n", "_need"))
        placed = rows.withColumn("_ci", F.shiftright("_i", shift)).withColumn("_cj", F.shiftright("_j", shift))
        placed = placed.join(maybe_broadcast(cells.select("_ci", "_cj", divided.alias("_divided")), told["n"], ROW_BYTES), ["_ci", "_cj"])
        placed = cut(placed) if told["need"] else placed
        leaves.append(found.where("not _divided").drop("_divided").withColumn("_shift", F.lit(shift)))
        held.append(placed.where("not _divided").select(F.lit(shift).alias("_shift"), "_ci", "_cj", "order", "x", "y"))
        if not told["need"]:
            break
        open_, rows = found.where("_divided").drop("_divided", "_least"), placed.where("_divided").drop("_divided", "_ci", "_cj")
        step = shift - max(0, told["need"] - BITS)
        shift -= step
    ends = reduce(DataFrame.unionByName, leaves).withColumn("_bound", F.min("_bound").over(Window.partitionBy("_pid"))).where(F.col("_least") <= F.col("_bound"))
    met = ends.join(maybe_broadcast(reduce(DataFrame.unionByName, held), span["n"], ROW_BYTES), ["_shift", "_ci", "_cj"]).withColumn("d2", _d2(F.col("_px") - F.col("x"), F.col("_py") - F.col("y"))).where(F.col("d2") <= F.col("_bound"))
    met = met.where(F.col("order") != F.col("_self")) if itself else met
    best = met.groupBy("_pid").agg(F.min_by(F.struct("order", "x", "y", "d2"), F.struct("d2", "order")).cast(shape).alias("near"))
    return asked.join(best, "_pid", "left").select("_probe.*", "near", again).drop("_copy")
