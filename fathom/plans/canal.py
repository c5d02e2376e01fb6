"""Canal model: cross-sections laid into a grid, objects from shadows, and the echo mosaic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import ground_range, half_up, lat_of, lon_of
from fathom.operators import asof, grid, groups, session
from fathom.operators.arrays import staged
from fathom.operators.section import RELIEF_STEP
from fathom.plans import survey as read
from fathom.plans.align import KEY
from fathom.plans.lake import DRAFT_M
from fathom.session import cut

# A cell's sources and their ranks, the highest wins; height of the dry strip.
SOURCES = {"measured": 1, "bed": 2, "bank": 3, "bank_assumed": 4, "land": 5, "object": 6}
RANKS = {"measured": 6, "bed": 5, "bank": 4, "bank_assumed": 3, "land": 2, "object": 7}
LAND_M, STRIP_M = 0.35, 1.5
# The longest gap in the track that sections are blended over.
MOST_GAP_M, MOST_GAP_S = 2.0, 5.0
CELL_M = 0.2


@dataclass
class CanalModel:
    """pings, sides (one row for each side of a ping), cells (survey, i, j, depth, source) and objects."""

    pings: DataFrame
    sides: DataFrame
    cells: DataFrame
    objects: DataFrame
    cell_m: float


def sides_of(pings: DataFrame, draft_m: float, sensitivity: float, shading: float) -> DataFrame:
    """Both readings of every side, settled along the track, with relief averaged over .3 m to either side."""
    first = read.outlines(pings, draft_m)
    second = read.readings(pings, read.references(first), draft_m, sensitivity)
    sides = read.smooth_banks(first.drop("row").join(second, ["survey", "ping", "side"]), draft_m)
    each = sides.select("survey", "side", "ping", "along", F.posexplode("relief").alias("g", "r"))
    w = read.within(["survey", "side", "g"], "along", 0.3)
    mean = each.withColumn("m", shading * F.avg("r").over(w)).groupBy("survey", "side", "ping").agg(F.array_sort(F.collect_list(F.struct("g", "m"))).alias("l"))
    relief = mean.select("survey", "side", "ping", F.transform("l", lambda x: x["m"]).alias("relief"))
    return sides.drop("relief").join(relief, ["survey", "side", "ping"], "left")


def section_value(a: Column) -> tuple[Column, Column]:
    """(depth, source) of a side at the distance a: bed, bank up to the waterline, then a dry strip."""
    reach = F.size("relief") * RELIEF_STEP
    bump = F.coalesce(F.try_element_at("relief", (F.floor(a / RELIEF_STEP) + 1).cast("int")), F.lit(0.0))
    plain = F.col("baseline") + F.col("anomaly") * F.exp(-0.5 * (a / 1.2) * (a / 1.2))
    shaded = F.col("baseline") + F.col("anomaly") * F.greatest(F.lit(0.0), 1 - a / reach) - bump
    bed = F.when(F.col("relief").isNull(), plain).otherwise(shaded)
    on_bed = F.col("open") | (a <= F.col("toe"))
    bank = F.col("baseline") * (F.col("waterline") - a) / (F.col("waterline") - F.col("toe"))
    land = -LAND_M * F.least(F.lit(1.0), (a - F.col("waterline")) / 0.6)
    name = F.when(on_bed, F.when(a < 0.6, "measured").otherwise("bed")).when(a <= F.col("waterline"), F.when(F.col("assumed"), "bank_assumed").otherwise("bank")).otherwise("land")
    return F.when(on_bed, bed).when(a <= F.col("waterline"), bank).otherwise(land), name


def lay_sections(pings: DataFrame, sides: DataFrame, cell: float) -> DataFrame:
    """(survey, i, j, depth, source): weighted means where cross-sections meet, the best source of each cell.

    Where pings are missing over 0.7 cells to two metres of track and at most five seconds, sections blended from both sides
    of the gap are laid as well.
    """
    shape = pings.select("survey", "ping", "t", "x", "y", "hx", "hy", "baseline", "anomaly")
    step = cell / 2
    far = F.when(F.col("open"), F.col("reach")).otherwise(F.col("waterline") + STRIP_M)
    out = sides.where("not empty").select("survey", "ping", "side", "open", "reach", "waterline", "toe", "assumed", "relief").join(shape, ["survey", "ping"])
    sign = F.when(F.col("side") == 0, 1.0).otherwise(-1.0)  # port lies to the left of the heading
    places = F.transform(F.sequence(F.lit(0), F.floor(far / step).cast("int")), lambda k: k * step)
    values = staged(out, ox=-sign * F.col("hy"), oy=sign * F.col("hx"), d=F.transform(places, lambda a: section_value(a)[0]), s=F.transform(places, lambda a: section_value(a)[1]))
    laid = values.select("survey", "side", "t", "ping", "x", "y", "ox", "oy", "d", "s")
    gap = F.hypot(F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y"))
    short = (F.col("_gap") > 0.7 * cell) & (F.col("_gap") <= MOST_GAP_M) & (F.col("t") - F.col("prev.t") <= MOST_GAP_S)
    between = session.blend_rows(laid, ["survey", "side"], ["t", "ping"], gap, step, ["x", "y", "ox", "oy"], ["d"], ["s"], short)
    every = laid.drop("t", "ping").unionByName(between.drop("share"))
    unit = F.coalesce(F.nullif(F.hypot("ox", "oy"), F.lit(0.0)), F.lit(1.0))
    steps = every.select("survey", "x", "y", (F.col("ox") / unit).alias("ox"), (F.col("oy") / unit).alias("oy"), F.posexplode(F.arrays_zip("d", "s")).alias("k", "v")).withColumn("a", F.col("k") * step)
    points = steps.select("survey", (F.col("x") + F.col("a") * F.col("ox")).alias("px"), (F.col("y") + F.col("a") * F.col("oy")).alias("py"), F.col("v.d").alias("d"), F.col("v.s").alias("s"), "a")
    w = 1 / (1 + (F.col("a") / 5) * (F.col("a") / 5))
    rank = F.try_element_at(F.create_map(*[F.lit(v) for pair in RANKS.items() for v in pair]), F.col("s"))
    cells = points.groupBy("survey", grid.cell_of("px", cell).alias("i"), grid.cell_of("py", cell).alias("j"))
    return cells.agg((F.sum(F.col("d") * w) / F.sum(w)).alias("depth"), F.max_by("s", rank).alias("source"))


def detections(pings: DataFrame, sides: DataFrame) -> DataFrame:
    """(survey, id, kind, x, y, hx, hy, ox, oy, t, along, side, ...): every feature as a point on the ground."""
    each = sides.where("not empty").select("survey", "ping", "side", "open", "toe", F.explode("features").alias("f"))
    edge = F.when(F.col("f.kind") == "object", F.col("f.end")).otherwise(F.col("f.start"))
    each = each.withColumn("edge", edge).where(F.col("open") | (F.col("edge") < F.col("toe")))
    at = each.join(pings.select("survey", "ping", "t", "x", "y", "hx", "hy", "along", "height", "baseline"), ["survey", "ping"])
    sign = F.when(F.col("side") == 0, 1.0).otherwise(-1.0)
    ox, oy = -sign * F.col("hy"), sign * F.col("hx")
    return at.select(
        "survey", F.xxhash64("survey", "ping", "side", "edge").alias("id"), F.col("f.kind").alias("kind"), (F.col("x") + ox * F.col("edge")).alias("x"), (F.col("y") + oy * F.col("edge")).alias("y"),
        "hx", "hy", ox.alias("ox"), oy.alias("oy"), "t", "along", "side", F.col("edge").alias("offset"), F.col("f.height").alias("raised"), F.col("f.lit").alias("lit"),
        (F.col("f.shadow_end") - F.col("f.shadow_start")).alias("shadow"), F.col("f.contrast").alias("contrast"), "baseline", F.col("height").alias("water"),
    )


def objects_of(found: DataFrame, least_pings: int = 3, least_span: float = 0.25) -> DataFrame:
    """One row for each group of detections: each joins the newest of the last twelve groups whose last detection is of its
    kind, within 1.2 m and 3 s before it."""
    joined = groups.last_near(found, KEY, "kind", "x", "y", "t", ["side", "offset"], 1.2, 3.0, 12, "_group")
    named = cut(joined.withColumn("cluster", F.xxhash64("survey", "_part", "_group")).drop("_part", "_group"))
    frame = named.groupBy("survey", "cluster").agg(F.sum("ox").alias("_ox"), F.sum("oy").alias("_oy"), F.min_by(F.struct("x", "y", "hx", "hy"), F.struct("t", "id")).alias("o"))
    norm = F.nullif(F.sqrt(F.col("_ox") * F.col("_ox") + F.col("_oy") * F.col("_oy")), F.lit(0.0))
    frame = frame.withColumn("ux", F.coalesce(F.col("_ox") / norm, F.lit(1.0))).withColumn("uy", F.coalesce(F.col("_oy") / norm, F.lit(0.0)))
    turn = F.when(F.col("uy") * F.col("o.hx") - F.col("ux") * F.col("o.hy") < 0, -1.0).otherwise(1.0)
    frame = frame.select("survey", "cluster", "o", "ux", "uy", (turn * F.col("uy")).alias("vx"), (-turn * F.col("ux")).alias("vy"))
    placed = named.join(frame, ["survey", "cluster"])
    rx, ry = F.col("x") - F.col("o.x"), F.col("y") - F.col("o.y")
    placed = placed.withColumn("_a", rx * F.col("vx") + ry * F.col("vy")).withColumn("_c", rx * F.col("ux") + ry * F.col("uy"))
    total = placed.groupBy("survey", "cluster", "kind", "o", "ux", "uy", "vx", "vy").agg(
        F.count("*").alias("n"), F.countDistinct("t").alias("pings"), F.count("lit").alias("_lits"), F.percentile("lit", 0.5).alias("_lit"), F.min("_a").alias("_a0"), F.max("_a").alias("_a1"),
        F.percentile("_c", 0.5).alias("_c"), F.percentile("raised", 0.75).alias("height"), F.percentile("t", 0.5).alias("time"), F.percentile("shadow", 0.5).alias("shadow_m"), F.percentile("contrast", 0.5).alias("contrast"),
        F.percentile("along", 0.5).alias("along_m"), F.percentile("offset", 0.5).alias("offset_m"), F.min("side").alias("_side"), F.percentile("baseline", 0.5).alias("bed_depth"), F.percentile("water", 0.5).alias("_water"),
    )
    lit = F.col("_lits") * 2 >= F.col("n")
    length = F.greatest(F.lit(0.3), F.col("_a1") - F.col("_a0") + 0.3)
    width = F.least(F.lit(3.0), F.greatest(F.lit(0.3), F.when(lit, F.col("_lit")).otherwise(0.75 * length)))
    across = F.col("_c") + F.when(F.col("kind") == "object", -1.0).otherwise(1.0) * width * F.when(lit, 0.5).otherwise(0.3)
    middle = (F.col("_a0") + F.col("_a1")) / 2
    sized = total.withColumns({"length": length, "width": width, "span": F.col("_a1") - F.col("_a0"), "x": F.col("o.x") + middle * F.col("vx") + across * F.col("ux"), "y": F.col("o.y") + middle * F.col("vy") + across * F.col("uy"), "heading": F.atan2("vy", "vx")})
    tall = F.greatest(F.lit(0.05), 0.08 * F.col("_water"))
    kept = sized.where((F.col("n") >= least_pings) & (F.col("span") >= least_span) & (F.col("height") >= tall))
    side = F.when(F.col("_side") == 0, "port").otherwise("starboard")
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("time", "cluster"))
    return kept.select("survey", number.alias("id"), F.when(F.col("kind") == "object", "raised").otherwise("depression").alias("kind"), "x", "y", "height", "width", "length", "span", "heading", "time", "pings", "shadow_m", "contrast", "bed_depth", (F.col("bed_depth") - F.col("height")).alias("top_depth"), side.alias("side"), "offset_m", "along_m")


def canal_model(frames: DataFrame, track: DataFrame, sync: DataFrame, draft_m: float = DRAFT_M, sensitivity: float = 0.5, shading: float = 0.8, cell: float = CELL_M, fill_passes: int = 3, time_range: tuple[float, float] | None = None, stride: int = 1, track_rows: int | None = None, most_pings: int | None = None) -> CanalModel:
    """The model of all surveys; frames need their samples. With track_rows a survey's track is spread over tasks of so many rows."""
    pings = cut(read.baselines(read.steady_track(read.placed_pings(frames, track, sync, time_range, stride, track_rows, most_pings), track_rows), draft_m))
    sides = cut(sides_of(pings, draft_m, sensitivity, shading))
    cells = cut(lay_sections(pings, sides, cell))
    filled = cells.select("survey", "i", "j", F.col("depth").alias("value"))
    for _ in range(fill_passes):
        filled = cut(grid.fill_pass(filled, keys=KEY))
    cells = filled.withColumnRenamed("value", "depth").join(cells.select("survey", "i", "j", "source"), ["survey", "i", "j"], "left").fillna("bed", ["source"])
    objects = cut(objects_of(detections(pings, sides)))
    raised = objects.where("kind = 'raised'").select("survey", "id", "x", "y", (F.col("length") / 2).alias("half_length"), (F.col("width") / 2).alias("half_width"), "heading", "height")
    bumps = grid.stamp(raised, cell, KEY)
    cells = cells.join(bumps, ["survey", "i", "j"], "left").select("survey", "i", "j", (F.col("depth") - F.coalesce("raised", F.lit(0.0))).alias("depth"), F.when(F.col("id").isNotNull(), "object").otherwise(F.col("source")).alias("source"))
    return CanalModel(pings, sides, cells, objects, cell)


def located(objects: DataFrame, pings: DataFrame) -> DataFrame:
    """objects with lon and lat."""
    origin = pings.groupBy("survey").agg(F.first("lon0").alias("lon0"), F.first("lat0").alias("lat0"))
    o = objects.join(origin, "survey")
    return o.withColumn("lon", lon_of(F.col("x"), F.col("lon0"), F.col("lat0"))).withColumn("lat", lat_of(F.col("y"), F.col("lat0"))).drop("lon0", "lat0")


def bank_summary(sides: DataFrame) -> DataFrame:
    """(survey, side, waterline, toe, slope, assumed): medians where at least half of a side is closed."""
    closed = ~F.col("open")
    slope = F.col("height") / F.nullif(F.col("waterline") - F.col("toe"), F.lit(0.0))
    out = sides.groupBy("survey", "side").agg(F.avg(closed.cast("double")).alias("_share"), F.percentile("waterline", 0.5).alias("waterline"), F.percentile("toe", 0.5).alias("toe"), F.percentile(F.when(closed, slope), 0.5).alias("slope"), (F.avg(F.when(closed, F.col("assumed").cast("double"))) >= 0.5).alias("assumed"))
    return out.where("_share >= 0.5").drop("_share")


def mosaic(pings: DataFrame, sides: DataFrame, texel: float, draft_m: float = DRAFT_M) -> DataFrame:
    """(survey, a, b, value, hits, shade): mean echo of each texel over the bed and banks of both sides, and how many
    of its echoes lie in a shadow. Echoes in a shadow are spread evenly between its ends on the bed."""
    pairs = F.regexp_extract_all(F.hex("samples"), F.lit(".."), F.lit(0))
    raw = pings.select("survey", "ping", "x", "y", "hx", "hy", "height", "range_m", pairs.alias("_s")).where("size(_s) >= 2")
    far = F.when(F.col("open"), F.col("reach")).otherwise(F.col("waterline"))
    edge = sides.where("not empty").select("survey", "ping", "side", far.alias("far"), F.when(~F.col("open") & (F.col("toe") < far), F.col("toe")).alias("toe"), "features")
    n = F.floor(F.size("_s") / 2).cast("int")
    own = F.when(F.col("side") == 0, F.reverse(F.slice("_s", F.lit(1), n))).otherwise(F.slice("_s", n + 1, n))
    each = raw.join(edge, ["survey", "ping"]).select("survey", "side", "x", "y", "hx", "hy", "height", "range_m", "far", "toe", "features", n.alias("n"), F.posexplode(own).alias("k", "v"))
    r = (F.col("k") + 0.5) * F.col("range_m") / F.col("n")
    top = lambda f: F.col("height") - F.when(f["kind"] == "object", f["height"]).otherwise(0.0)
    first = lambda f: F.sqrt(f["shadow_start"] * f["shadow_start"] + top(f) * top(f))
    last = lambda f: F.sqrt(f["shadow_end"] * f["shadow_end"] + F.col("height") * F.col("height"))
    hit = F.get(F.filter("features", lambda f: (r >= first(f)) & (r < last(f))), F.lit(0))
    each = each.withColumn("_f", hit)
    f = F.col("_f")
    behind = f["shadow_start"] + (f["shadow_end"] - f["shadow_start"]) * (r - first(f)) / (last(f) - first(f))
    each = each.withColumn("g", F.when(f.isNotNull(), behind).otherwise(ground_range(r, F.col("height"), F.lit(draft_m), F.col("toe"), F.col("far"))))
    sign = F.when(F.col("side") == 0, 1.0).otherwise(-1.0)
    on = each.where("g > 0").select("survey", (F.col("x") - sign * F.col("g") * F.col("hy")).alias("px"), (F.col("y") + sign * F.col("g") * F.col("hx")).alias("py"), F.conv("v", 16, 10).cast("int").alias("v"), f.isNotNull().alias("dark"))
    return on.groupBy("survey", grid.cell_of("px", texel).alias("a"), grid.cell_of("py", texel).alias("b")).agg(F.avg("v").alias("value"), F.count("*").alias("hits"), F.count_if("dark").alias("shade"))


def picture(texels: DataFrame, texel: float) -> DataFrame:
    """(survey, a, b, value, level, shadow) of a mosaic: gaps filled from three of eight neighbours over half a metre,
    within its bounds; level runs from 0 to 255 between a survey's 2nd and 98th percentile (of values to a
    hundredth, so that a survey has few different ones); shadow where half the echoes or more lie in one."""
    box = texels.groupBy("survey").agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in ("a", "b") for f in (F.min, F.max)])
    held = texels.select("survey", F.col("a").alias("i"), F.col("b").alias("j"), "value")
    inside = F.col("i").between(F.col("_min_a"), F.col("_max_a")) & F.col("j").between(F.col("_min_b"), F.col("_max_b"))
    for _ in range(max(2, math.ceil(0.5 / texel))):
        held = cut(grid.fill_pass(held, reach4=False, least=3, keys=KEY).join(box, "survey").where(inside).select("survey", "i", "j", "value"))
    ends = held.groupBy("survey").agg(F.percentile(F.round("value", 2), 0.02).alias("_lo"), F.percentile(F.round("value", 2), 0.98).alias("_hi"))
    level = half_up((F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6)) * 255)
    dark = texels.where("shade * 2 >= hits").select("survey", F.col("a").alias("i"), F.col("b").alias("j"), F.lit(True).alias("_dark"))
    shown = held.join(ends, "survey").join(dark, ["survey", "i", "j"], "left")
    return shown.select("survey", F.col("i").alias("a"), F.col("j").alias("b"), "value", F.least(F.greatest(level, F.lit(0)), F.lit(255)).cast("int").alias("level"), F.coalesce("_dark", F.lit(False)).alias("shadow"))


def sections(model: CanalModel, points: DataFrame, step: float = 0.1, most: float = 20.0, slack_s: float = 5.0) -> DataFrame:
    """(columns of points, along, o, depth): the model's depths across the track at selected points (survey, t, ...).

    A point takes the cross-section of the ping nearest in time, from port (positive o) to starboard; one more
    than slack_s outside its survey's pings, or with fewer than three depths, has no rows.
    """
    far = F.least(F.when(F.col("open"), F.col("reach")).otherwise(F.col("waterline") + STRIP_M), F.lit(most))
    reach = model.sides.groupBy("survey", "ping").agg(*[F.coalesce(F.max(F.when(F.col("side") == k, far)), F.lit(0.0)).alias(n) for k, n in ((0, "port"), (1, "starboard"))])
    pings = model.pings.select("survey", "ping", "t", "x", "y", "hx", "hy", "along").join(reach, ["survey", "ping"])
    names = points.columns
    asked = points.distinct()
    near = asof.nearest_in_time(asked, pings, KEY, "t", ["x", "y", "hx", "hy", "along", "port", "starboard"], ["ping"])
    spans = pings.groupBy("survey").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    near = near.join(spans, "survey").where(F.col("t").between(F.col("_t0") - slack_s, F.col("_t1") + slack_s))
    offsets = F.transform(F.sequence(F.lit(0), F.floor((F.col("near.port") + F.col("near.starboard")) / step + 1e-9).cast("int")), lambda k: F.col("near.port") - k * step)
    each = near.withColumn("o", F.explode(offsets))
    each = each.select(*names, F.col("near.along").alias("along"), "o", (F.col("near.x") - F.col("o") * F.col("near.hy")).alias("_px"), (F.col("near.y") + F.col("o") * F.col("near.hx")).alias("_py"))
    deep = grid.bilinear(each, model.cells, "_px", "_py", model.cell_m, "depth", "depth", KEY).where("depth is not null")
    enough = deep.withColumn("_n", F.count("*").over(Window.partitionBy(*names))).where("_n >= 3")
    return enough.select(*names, "along", "o", "depth")


def crossing(found: DataFrame, objects: DataFrame, margin: float = 0.4) -> DataFrame:
    """(survey, t, id, o): the objects whose extent along the track crosses the sections; o as there."""
    at = found.select("survey", "t", "along").distinct().withColumn("_m", F.floor("along"))
    half = F.col("length") / 2 + margin
    wide = objects.select("survey", "id", "along_m", "length", F.when(F.col("side") == "port", F.col("offset_m")).otherwise(-F.col("offset_m")).alias("o")).withColumn("_m", F.explode(F.sequence(F.floor(F.col("along_m") - half), F.floor(F.col("along_m") + half))))
    return at.join(wide, ["survey", "_m"]).where(F.abs(F.col("along_m") - F.col("along")) <= half).select("survey", "t", "id", "o")
