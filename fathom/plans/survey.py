"""Survey read: pings with headings, heights and cross-sections.

Readings of one ping are array functions on its row; everything that looks along the track is a window by survey.
Windows along the track are RANGE frames in seconds or metres, so that no data-dependent row
count has to be known first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathom.functions.geo import local_x, local_y
from fathom.operators import arrays, sample, section, session
from fathom.operators import track as long_track
from fathom.plans.align import GAP_S, KEY, interpolator, resolve_positions, survey_key
from fathom.plans.lake import DRAFT_M, accepted_depths

HEADING_S = 2.5
LEAST_STEP_M, LEAST_COSINE, MOST_RATIO, MOST_LATERAL_M = 0.6, 0.9063, 2.2, 1.0
LEAST_TURN_M, MOST_TURN_DEG = 0.3, 30.0
RUN_STEP_M, RUN_STEP_S, LEAST_RUN_M = 1.5, 2.0, 3.0
REFERENCE_M = 15.0


def within(keys: list[str], column: str, reach: float) -> WindowSpec:
    """Rows within reach of each row's value of a column, to a thousandth."""
    return Window.partitionBy(*keys).orderBy((F.col(column) * 1000).cast("long")).rangeBetween(-round(reach * 1000), round(reach * 1000))


def placed_pings(frames: DataFrame, track: DataFrame, sync: DataFrame, time_range: tuple[float, float] | None = None, stride: int = 1, track_rows: int | None = None, most_pings: int | None = None) -> DataFrame:
    """(survey, ping, t, x, y, hx, hy, height, range_m, samples, lon0, lat0): side-scan pings with a steady heading.

    Every stride-th ping is read; with most_pings (an interactive survey takes 8,000) each survey has the step that keeps to it.
    """
    depths = accepted_depths(frames, time_range, track_rows)
    origin = depths.groupBy("survey").agg(F.percentile("lon", 0.5).alias("lon0"), F.percentile("lat", 0.5).alias("lat0"))
    side = survey_key(frames).where("channel = 5 and ping_size >= 16 and max_range_ft > 0").withColumn("t", F.col("time_ms") / 1000)
    if time_range is not None:
        side = side.where(F.col("t").between(*time_range))
    order = ["time_ms", "offset"]
    chosen = sample.within_budget(side, KEY, order, most_pings) if most_pings else sample.stride_sample(side, KEY, order, stride)
    chosen = chosen.withColumn("ping", F.col("offset"))
    probes = chosen.select("survey", "ping", "t", "lon", "lat").withColumn("dt", F.explode(F.array(*[F.lit(x) for x in (-HEADING_S, 0.0, HEADING_S)]))).withColumn("t", F.col("t") + F.col("dt"))
    at = resolve_positions(probes, frames, track, sync, track_rows).where("pos_lon is not null").join(origin, "survey")
    x, y = local_x(F.col("pos_lon"), F.col("lon0"), F.col("lat0")), local_y(F.col("pos_lat"), F.col("lat0"))
    at = at.select("survey", "ping", "dt", x.alias("x"), y.alias("y"), "lon0", "lat0")
    three = at.groupBy("survey", "ping").agg(*[F.max(F.when(F.col("dt") == d, F.col(c))).alias(f"{c}{k}") for c in ("x", "y") for k, d in (("a", -HEADING_S), ("", 0.0), ("b", HEADING_S))], F.first("lon0").alias("lon0"), F.first("lat0").alias("lat0"))
    bx, by, ax, ay = F.col("x") - F.col("xa"), F.col("y") - F.col("ya"), F.col("xb") - F.col("x"), F.col("yb") - F.col("y")
    before, after = F.sqrt(bx * bx + by * by), F.sqrt(ax * ax + ay * ay)
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    length = F.sqrt(dx * dx + dy * dy)
    headed = three.withColumns({"_before": before, "_after": after, "_length": length, "_turn": bx * ax + by * ay, "_lateral": F.abs(bx * dy - by * dx) / F.nullif(length, F.lit(0.0)), "hx": dx / F.nullif(length, F.lit(0.0)), "hy": dy / F.nullif(length, F.lit(0.0))})
    steady = (
        (F.col("_before") >= LEAST_STEP_M) & (F.col("_after") >= LEAST_STEP_M) & (F.col("_turn") >= LEAST_COSINE * F.col("_before") * F.col("_after"))
        & (F.greatest("_before", "_after") <= MOST_RATIO * F.least("_before", "_after")) & (F.col("_lateral") <= MOST_LATERAL_M)
    )
    headed = headed.where(F.coalesce(steady, F.lit(False))).select("survey", "ping", "x", "y", "hx", "hy", "lon0", "lat0")
    pings = chosen.select("survey", "ping", "t", "depth_m", (F.col("max_range_ft") * 0.3048).alias("range_m"), "samples").join(headed, ["survey", "ping"])
    high = interpolator(track_rows)(pings, depths, KEY, "t", ["depth_m"], ["offset"], GAP_S)
    return high.withColumn("height", F.coalesce("at_depth_m", "depth_m")).where("height > 0.1").drop("at_depth_m", "depth_m")


def steady_track(pings: DataFrame, track_rows: int | None = None) -> DataFrame:
    """pings near their rolling-median track and in its direction, in runs of three metres or more, with smoothed
    headings and along. A survey of fewer than ten pings isn't compared with its median track."""
    near = within(KEY, "t", 3)
    mx, my = F.percentile("x", 0.5).over(near), F.percentile("y", 0.5).over(near)
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    ahead = within(KEY, "t", 1.5)
    tx, ty = (F.last(c).over(ahead) - F.first(c).over(ahead) for c in ("_mx", "_my"))
    length = F.sqrt(F.col("_tx") ** 2 + F.col("_ty") ** 2)
    straight = (length < LEAST_TURN_M) | (F.col("_tx") * F.col("hx") + F.col("_ty") * F.col("hy") > length * math.cos(math.radians(MOST_TURN_DEG)))
    medians = pings.withColumn("_mx", mx).withColumn("_my", my).withColumn("_few", F.count("*").over(Window.partitionBy(*KEY)) < 10).withColumn("_tx", tx).withColumn("_ty", ty)
    kept = medians.where(F.col("_few") | (dx * dx + dy * dy <= RUN_STEP_M * RUN_STEP_M) & straight).drop("_mx", "_my", "_tx", "_ty", "_few")
    step = F.sqrt(F.pow(F.col("x") - F.col("prev.x"), 2) + F.pow(F.col("y") - F.col("prev.y"), 2))
    narrow = kept.select("survey", "ping", "t", "x", "y", "hx", "hy")
    apart = (step >= RUN_STEP_M) | (F.col("t") - F.col("prev.t") >= RUN_STEP_S)
    if track_rows:
        cut = long_track.sessionise(narrow, KEY, "t", ["ping"], apart, "run", track_rows)
    else:
        cut = session.sessionise(narrow, KEY, ["t", "ping"], apart, "run")
    w = Window.partitionBy(*KEY, "run").orderBy("t", "ping")
    stepped = cut.withColumn("_d", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)))
    long = session.long_runs(stepped, KEY, "run", "_d", LEAST_RUN_M).drop("_d")
    beside = within([*KEY, "run"], "t", 1)
    sx, sy = F.sum("hx").over(beside), F.sum("hy").over(beside)
    turned = long.withColumn("_sx", sx).withColumn("_sy", sy).withColumn("_n", F.sqrt(F.col("_sx") ** 2 + F.col("_sy") ** 2))
    turned = turned.withColumn("hx", F.when(F.col("_n") > 0, F.col("_sx") / F.col("_n")).otherwise(F.col("hx"))).withColumn("hy", F.when(F.col("_n") > 0, F.col("_sy") / F.col("_n")).otherwise(F.col("hy"))).drop("_sx", "_sy", "_n")
    forward = (F.col("x") - F.col("prev.x")) * F.col("hx") + (F.col("y") - F.col("prev.y")) * F.col("hy")
    along = F.when(F.col("t") - F.col("prev.t") > RUN_STEP_S, step).otherwise(F.greatest(forward, F.lit(0.0)))
    ordered = session.cumulative(turned, KEY, ["t", "ping"], along, "along")
    return kept.drop("hx", "hy", "t", "x", "y").join(ordered, ["survey", "ping"])


def halves(pings: DataFrame, *columns: str) -> DataFrame:
    """pings with a row for each side: side (0 port, 1 starboard) and its samples outward as echo, instead of samples."""
    port, starboard = arrays.split_halves(arrays.bytes_of(F.col("samples")))
    each = F.posexplode(F.array(port, starboard)).alias("side", "echo")
    kept = pings.select("survey", "ping", "height", "range_m", *columns, each)
    return kept.withColumn("echo", F.transform("echo", lambda x: x.cast("double"))).where(F.size("echo") > 0)


def outlines(pings: DataFrame, draft_m: float = DRAFT_M) -> DataFrame:
    """(survey, ping, side, along, height, open, reach, waterline, empty, row): both sides of each ping, first reading."""
    read = section.outline(halves(pings, "along"), draft_m)
    return read.select("survey", "ping", "side", "along", "height", "open", "reach", "waterline", "empty", "row")


def references(sides: DataFrame) -> DataFrame:
    """(survey, side, ping, reference): the usual echo by range, over REFERENCE_M of track to either side.

    Exploded to (side, range bin) series, so the windows are many and each as long as a survey.
    """
    each = sides.select("survey", "side", "ping", "along", F.posexplode("row").alias("bin", "v"))
    w = within(["survey", "side", "bin"], "along", REFERENCE_M)
    mean = F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v") - 1.0)).over(w), F.lit(0.0))
    held = each.withColumn("m", mean).groupBy("survey", "side", "ping").agg(F.array_sort(F.collect_list(F.struct("bin", "m"))).alias("l"))
    return held.select("survey", "side", "ping", F.transform("l", lambda x: x["m"]).alias("reference"))


def readings(pings: DataFrame, reference: DataFrame, draft_m: float = DRAFT_M, sensitivity: float = 0.5) -> DataFrame:
    """(survey, ping, side, toe, assumed, features, relief): the second reading, against the reference."""
    sides = halves(pings).join(reference, ["survey", "ping", "side"])
    read = section.toe(section.shadows(section.outline(sides, draft_m), sensitivity), draft_m)
    inner = F.greatest(F.lit(0.0), F.coalesce("toe", F.lit(0.0)) - 0.5)
    stop = F.when(F.col("open"), F.col("n")).otherwise(F.least(F.col("end"), F.floor(F.hypot(inner, F.col("height")) / F.col("dr")).cast("int")))
    return section.relief(read, stop).select("survey", "ping", "side", "toe", "assumed", "features", "relief")


def smooth_banks(sides: DataFrame, draft_m: float = DRAFT_M) -> DataFrame:
    """sides with open, waterline, toe and assumed settled by their neighbours along the track."""
    w = within(["survey", "side"], "along", REFERENCE_M)
    mostly = F.avg(F.when(~F.col("empty"), (~F.col("open")).cast("double"))).over(w)
    water, toe = F.percentile("waterline", 0.5).over(w), F.percentile("toe", 0.5).over(w)
    assumed = F.avg(F.when(F.col("toe").isNotNull(), F.col("assumed").cast("double"))).over(w)
    closed = F.coalesce((F.col("_share") >= 0.5) & F.col("_water").isNotNull(), F.lit(False))
    limit = F.least(F.coalesce("_toe", F.col("_water") - 2 * (F.col("height") + draft_m)), F.col("_water") - 0.3)
    out = sides.withColumns({"_share": mostly, "_water": water, "_toe": toe, "_assumed": assumed})
    return out.withColumn("open", ~closed).withColumn("waterline", F.when(closed, F.col("_water"))).withColumn("toe", F.when(closed, F.greatest(limit, F.lit(0.3)))).withColumn("assumed", closed & (F.coalesce("_assumed", F.lit(1.0)) >= 0.5)).drop("_share", "_water", "_toe", "_assumed")


def baselines(pings: DataFrame, draft_m: float = DRAFT_M) -> DataFrame:
    """pings with depth, its smoothed level along the track and the difference."""
    w = within(KEY, "along", REFERENCE_M)
    deep = pings.withColumn("depth", F.col("height") + draft_m)
    return deep.withColumn("baseline", F.percentile("depth", 0.5).over(w)).withColumn("anomaly", F.col("depth") - F.col("baseline"))
