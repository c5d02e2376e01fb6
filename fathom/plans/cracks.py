"""Screening of a lining for lines: raster by stretch, ridges, then lines as tables.

Echoes are normalised and placed by array functions on each side's row. Only the line filter over one bounded
stretch of the track at a time (with a margin, whose ridges are dropped) is NumPy. Ridge pixels are rows from there on: linking, fitting, merging,
echo removal, classes and ranks are joins and aggregations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import geo, text
from fathom.operators import asof, graph, groups, robust
from fathom.operators import lines as line_filter
from fathom.operators.arrays import staged
from fathom.operators.section import REFERENCE_STEP
from fathom.plans import survey as read
from fathom.plans.align import KEY
from fathom.session import cut

STRETCH_M, MARGIN_M = 20.0, 1.0
# The profile across a line, in columns: how far it reaches, and where the level beside the line, its shadow and lit faces are read.
PROFILE, LEVEL_BEFORE, LEVEL_BEHIND, SHADOW = 8, (-8, -6), (6, 8), (-3, 4)
FACE_BEFORE, FACE_BEHIND, LEAST_LIFT = ((-4, -2), (-3, -1)), ((2, 4), (1, 2)), 0.08
# What is left out beside a compact object and before its lit face, and which groups are such objects.
BESIDE_M, LIT_FACE_M, LEAST_HITS, MOST_OBJECT_M = 0.3, 0.6, 3, 3.0
MOST_OFFSET_M, MOST_PIXELS = 20.0, 6_000_000
LEAST_SEGMENT_M, MOST_RMS_M = 0.15, 0.035
LEAST_WOBBLE_M, LEAST_SLOPE, LEAST_ROWS = 0.05, 0.5, 10
LEAST_JOINT_M, MOST_JOINT_M, JOINT_SPREAD = 1.5, 10.0, 0.15
RIDGE = "survey string, polarity string, i long, j long, z double, direction int"


def row_pitch(pings: DataFrame) -> float:
    """The upper median step along the track, within 1 to 10 cm; 5 cm without any."""
    w = Window.partitionBy(*KEY).orderBy("along", "ping")
    steps = pings.select((F.col("along") - F.lag("along").over(w)).alias("d")).where("d > 0")
    found = steps.agg(F.percentile("d", 0.5).alias("m")).first()["m"]
    return min(0.1, max(0.01, found or 0.05))


def compact_spans(detections: DataFrame) -> DataFrame:
    """(survey, side, low, high, left, right): where compact objects lie, along the track and across it. Each detection joins the oldest
    group less than .3 m behind it whose band it meets; groups of three or more over at most 3 m are objects, longer ones may be lines."""
    start = F.when(F.col("kind") == "object", F.col("offset") - F.coalesce("lit", F.lit(0.3))).otherwise(F.col("offset"))
    bands = detections.select("survey", "side", "id", "along", (start - LIT_FACE_M).alias("left"), (F.col("offset") + F.col("shadow") + BESIDE_M).alias("right"))
    found = groups.first_overlapping(bands, ["survey", "side"], "along", "left", "right", ["left", "id"], BESIDE_M, "_group")
    boxes = found.groupBy("survey", "side", "_part", "_group").agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.min("left").alias("left"), F.max("right").alias("right"))
    small = boxes.where((F.col("n") >= LEAST_HITS) & (F.col("high") - F.col("low") <= MOST_OBJECT_M))
    return small.select("survey", "side", (F.col("low") - BESIDE_M).alias("low"), (F.col("high") + BESIDE_M).alias("high"), "left", "right")


def ground_of(r: Column, draft: float) -> Column:
    """Ground range of a slant range: over the bed up to the toe (or the reach of an open side), then up the bank's straight
    slope to the waterline; null where the section holds none."""
    height, toe, waterline = F.col("height"), F.col("toe"), F.col("waterline")
    bed = F.when(r >= height, F.sqrt(F.greatest(F.lit(0.0), r * r - height * height)))
    m = (height + draft) / (waterline - toe)
    # The bank is z = m * (y - toe) - height; r^2 = y^2 + z^2 is solved for y, with c = height + m * toe.
    c = height + m * toe
    square = r * r * (1 + m * m) - c * c
    bank = F.when(square >= 0, (m * c + F.sqrt(F.greatest(F.lit(0.0), square))) / (1 + m * m))
    return F.when(F.col("open"), F.when(bed <= F.col("reach"), bed)).when(bed <= toe, bed).otherwise(F.when(bank.between(toe, waterline), bank))


def normalised(sides: DataFrame, draft: float) -> DataFrame:
    """sides (echo, reference and section of a ping's side, spans to leave out) with columns and values: the echoes over the
    usual echo at their range, by COLUMN_M from the track (port is positive). Left out are the strip below the boat, what lies near
    the toe or the waterline, and the spans."""
    near = lambda k: F.filter(F.slice("reference", F.greatest(k - 4, F.lit(1)), F.least(k + 5, F.lit(5)) + 6), lambda x: x > 0)
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x))
    wide = staged(sides, wide=F.transform("reference", lambda _, k: mean(near(k))), dr=F.col("range_m") / F.size("echo"))

    def place(v: Column, k: Column) -> Column:
        slant = (k + 0.5) * F.col("dr")
        usual = F.get("wide", F.least(F.floor(slant / REFERENCE_STEP).cast("int"), F.size("wide") - 1))
        return F.struct(ground_of(slant, draft).alias("g"), (v / usual).alias("v"), usual.alias("usual"))

    def seen(x: Column) -> Column:
        bank = F.col("open") | (F.abs(x["g"] - F.col("toe")) >= 0.3) & (x["g"] <= F.col("waterline") - 0.5)
        hidden = F.coalesce(F.exists("spans", lambda o: (x["g"] >= o["low"]) & (x["g"] <= o["high"])), F.lit(False))
        return F.coalesce((x["usual"] > 2) & (x["g"] >= F.greatest(F.lit(0.3), 0.3 * F.col("height"))) & bank & ~hidden, F.lit(False))

    outward = F.when(F.col("side") == 0, 1).otherwise(-1)
    kept = staged(wide, kept=F.filter(F.transform("echo", place), seen))
    column = lambda x: F.floor(outward * x["g"] / line_filter.COLUMN_M + 0.5).cast("int")
    return kept.withColumn("columns", F.transform("kept", column)).withColumn("values", F.transform("kept", lambda x: x["v"])).drop("kept", "wide", "dr")


def _ridges(pitch: float, low: float, stretch: float):
    """The ridges of one stretch, from the means of its normalised echoes by row and column."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["survey", "polarity", "i", "j", "z", "direction"])
        sizes = pdf["columns"].map(len).to_numpy()
        if not sizes.sum():
            return none
        i = np.concatenate(pdf["columns"].to_list()).astype(int)
        j = np.repeat(np.floor(pdf["along"].to_numpy() / pitch).astype(int), sizes)
        v = np.concatenate(pdf["values"].to_list()).astype(float)
        left, first = i.min(), j.min()
        shape = (int(j.max() - first) + 1, int(i.max() - left) + 1)
        if shape[0] * shape[1] > MOST_PIXELS:
            raise ValueError(f"a stretch of {shape[0]} x {shape[1]} pixels is too large to screen; choose a shorter one")
        at = (j - first) * shape[1] + i - left
        count = np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape)
        total = np.bincount(at, weights=v, minlength=shape[0] * shape[1]).reshape(shape)
        image = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        between = (line_filter.shifted(image, -1, 0) + line_filter.shifted(image, 1, 0)) / 2  # NaN unless both sides are known
        image = np.where(np.isnan(image), between, image)
        core, survey = int(pdf["stretch"].iloc[0]), pdf["survey"].iloc[0]
        rows = [(survey, p, a + left, b + first, z, d) for p, a, b, z, d in line_filter.ridges(image, line_filter.COLUMN_M, pitch, low)]
        return pd.DataFrame([r for r in rows if math.floor(r[3] * pitch / stretch) == core], columns=none.columns)

    return run


def echoes(pings: DataFrame, sides: DataFrame, reference: DataFrame, spans: DataFrame, draft_m: float = 0.2, only: DataFrame | None = None) -> DataFrame:
    """(survey, along, height, columns, values): the normalised echoes of every side, of the pings (survey, ping) in `only` if given."""
    chosen = pings if only is None else pings.join(only.select("survey", "ping").distinct(), ["survey", "ping"], "left_semi")
    # A ping meets the few objects beside it by metres of track.
    boxes = spans.withColumn("_m", F.explode(F.sequence(F.floor("low"), F.floor("high")))).select("survey", "side", "_m", "low", "high", F.struct(F.col("left").alias("low"), F.col("right").alias("high")).alias("span"))
    beside = chosen.select("survey", "ping", "along", F.floor("along").alias("_m")).join(boxes, ["survey", "_m"]).where(F.col("along").between(F.col("low"), F.col("high")))
    hidden = beside.groupBy("survey", "ping", "side").agg(F.collect_list("span").alias("spans"))
    both = (
        sides.where("not empty").select("survey", "ping", "side", "open", "reach", "waterline", "toe")
        .join(read.halves(chosen, "along"), ["survey", "ping", "side"])
        .join(reference, ["survey", "ping", "side"]).join(hidden, ["survey", "ping", "side"], "left")
    )
    most = math.floor(MOST_OFFSET_M / line_filter.COLUMN_M)
    placed = normalised(both, draft_m).withColumn("inside", F.filter(F.arrays_zip("columns", "values"), lambda x: F.abs(x["columns"]) <= most))
    return placed.select("survey", "along", "height", F.col("inside.columns").alias("columns"), F.col("inside.values").alias("values"))


def ridge_pixels(pings: DataFrame, sides: DataFrame, reference: DataFrame, spans: DataFrame, pitch: float, sensitivity: float = 0.5, draft_m: float = 0.2, stretch_m: float = STRETCH_M) -> DataFrame:
    """Ridge pixels of all stretches: column i by COLUMN_M from the track (port is positive), row j by pitch along it."""
    low = 6 - 3 * sensitivity - 1.5
    first, last = F.floor((F.col("along") - MARGIN_M) / stretch_m), F.floor((F.col("along") + MARGIN_M) / stretch_m)
    rows = echoes(pings, sides, reference, spans, draft_m).select("survey", "along", "columns", "values")
    spread = rows.withColumn("stretch", F.explode(F.sequence(first, last))).where("stretch >= 0")
    return spread.groupBy("survey", "stretch").applyInPandas(_ridges(pitch, low, stretch_m), RIDGE)


def profiles(found: DataFrame, pings: DataFrame, sides: DataFrame, reference: DataFrame, spans: DataFrame, pitch: float, draft_m: float = 0.2) -> DataFrame:
    """(survey, segment, water, profile): across lines along the track, the mean echo at every column from PROFILE before the line to
    as many behind it, away from the boat (a map by place), and the mean height of the transducer.

    A line meets the rows beside it by an equi-join, and only the pings of these rows are normalised again.
    """
    half = F.abs(F.sin("angle")) * F.col("length") / 2
    rows = F.sequence(F.floor((F.col("cy") - half) / pitch), F.ceil((F.col("cy") + half) / pitch))
    slope = F.cos("angle") / F.when(F.abs(F.sin("angle")) < 1e-9, 1e-9).otherwise(F.sin("angle"))
    spread = found.withColumn("j", F.explode(rows)).select("survey", "segment", "j", F.when(F.col("cx") >= 0, 1).otherwise(-1).alias("outward"), F.floor((F.col("cx") + (F.col("j") * pitch - F.col("cy")) * slope) / line_filter.COLUMN_M + 0.5).alias("i"))
    beside = pings.withColumn("j", F.floor(F.col("along") / pitch)).join(spread.select("survey", "j").distinct(), ["survey", "j"], "left_semi")
    held = echoes(pings, sides, reference, spans, draft_m, beside).withColumn("j", F.floor(F.col("along") / pitch))
    met = held.join(spread, ["survey", "j"])
    near = F.filter(F.arrays_zip("columns", "values"), lambda x: F.abs(x["columns"] - F.col("i")) <= PROFILE)
    each = met.select("survey", "segment", "height", "outward", "i", F.explode(near).alias("p"))
    means = each.groupBy("survey", "segment", (F.col("outward") * (F.col("p.columns") - F.col("i"))).cast("int").alias("m")).agg(F.avg("p.values").alias("v"), F.avg("height").alias("h"), F.count("*").alias("n"))
    return means.groupBy("survey", "segment").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("water"), F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("profile"))


def described(named: DataFrame, profile: DataFrame) -> DataFrame:
    """named with kind, detail and size_cm, read from the profile of a line along the track.

    A shadow's width is that of full darkness with the same deficit; what throws it is as high as water * width / range. An echo above
    the level beside the line tells a lit face: behind a dark line the far wall of an open gap, before it a raised edge.
    """

    def mean(a: int, b: int) -> Column:
        seen = F.filter(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda m: F.try_element_at("profile", m)), lambda v: v.isNotNull())
        return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.size(seen))

    level = (mean(*LEVEL_BEFORE) + mean(*LEVEL_BEHIND)) / 2
    lit = lambda places: F.coalesce(F.greatest(*[mean(*p) for p in places]) > level + LEAST_LIFT, F.lit(False))
    core = F.filter(F.transform(F.sequence(F.lit(SHADOW[0]), F.lit(SHADOW[1])), lambda m: F.try_element_at("profile", m)), lambda v: v.isNotNull())
    deficit = F.aggregate(core, F.lit(0.0), lambda s, v: s + F.greatest(F.lit(0.0), F.col("level") - v))
    width = deficit / F.greatest(F.lit(0.05), F.col("level") - F.array_min(F.map_values("profile"))) * line_filter.COLUMN_M
    out = named.join(profile, ["survey", "segment"], "left").withColumn("level", level).withColumn("before", lit(FACE_BEFORE)).withColumn("behind", lit(FACE_BEHIND))
    out = out.withColumn("width_m", F.when((F.col("polarity") == "dark") & (F.col("direction") == "along"), width))
    dark, along = F.col("polarity") == "dark", F.col("direction") == "along"
    kind = F.when(~along, F.when(dark, "crack").otherwise("edge")).when(~dark | F.col("before"), "step").otherwise("crack")
    detail = (
        F.when(~along, F.when(dark, "dark line").otherwise("lit edge"))
        .when(~dark, "step up facing the sonar: the far side stands higher")
        .when(F.col("before"), "raised edge casting a shadow")
        .when(F.col("behind"), "open crack: a gap with its far wall lit")
        .otherwise("crack, or a step down where the far side sits lower")
    )
    size = F.round(100 * F.col("water") * F.col("width_m") / (F.abs("cx") + F.col("width_m")), 1)
    return out.withColumn("kind", kind).withColumn("detail", detail).withColumn("size_cm", size).drop("level", "before", "behind", "water", "profile")


def _fits(points: DataFrame, keys: list[str]) -> DataFrame:
    fit = graph.line_fit(points, keys, "x", "y", "z")
    more = points.groupBy(*keys).agg(F.sum("z").alias("strength"), F.avg("z").alias("contrast"), F.max("z").alias("top"))
    out = fit.join(more, keys).withColumn("length", F.col("high") - F.col("low"))
    ends = {f"{c}{k}": F.col(f"c{c}") + F.col(e) * f("angle") for k, e in ((1, "low"), (2, "high")) for c, f in (("x", F.cos), ("y", F.sin))}
    return out.withColumns(ends).withColumn("degrees", F.degrees("angle"))


def segments(pixels: DataFrame, pitch: float, sensitivity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(points with a segment, fitted segments): linked pixels of similar direction, one of them strong enough."""
    high = 6 - 3 * sensitivity
    p = pixels.withColumn("id", F.xxhash64("survey", "polarity", "i", "j")).withColumn("x", F.col("i") * line_filter.COLUMN_M).withColumn("y", F.col("j") * pitch)
    turn = F.abs(F.col("p.direction") - F.col("q.direction"))
    linked = (F.col("p.survey") == F.col("q.survey")) & (F.col("p.polarity") == F.col("q.polarity")) & (F.least(turn, line_filter.DIRECTIONS - turn) <= 1)
    step = F.abs(F.col("p.i") - F.col("q.i")) <= 1
    roots = graph.connected_components(graph.cell_links(p, "id", "i", "j", 1.0, linked & step & (F.abs(F.col("p.j") - F.col("q.j")) <= 1)))
    named = cut(p.join(roots.withColumnsRenamed({"node": "id", "root": "segment"}), "id"))
    fitted = _fits(named, ["survey", "polarity", "segment"]).where((F.col("n") >= 4) & (F.col("top") >= high) & (F.col("length") >= LEAST_SEGMENT_M))
    fitted = cut(fitted)
    return cut(named.join(fitted.select("segment"), "segment", "left_semi")), fitted


def merged_lines(points: DataFrame, fitted: DataFrame, gap: float, lateral: float, only: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and lines after joining segments that continue each other; others stay as they are."""
    ask = fitted if only is None else fitted.where(only)
    named = ask.select(F.col("segment").alias("id"), "x1", "y1", "x2", "y2", F.col("degrees").alias("angle"), "survey", "polarity")
    # Surveys and polarities lie apart for the join.
    apart = F.pmod(F.xxhash64("survey", "polarity"), F.lit(1 << 20)) * 1e6
    roots = graph.merge_lines(named.withColumn("x1", F.col("x1") + apart).withColumn("x2", F.col("x2") + apart), gap, lateral)
    moved = points.join(roots.withColumnRenamed("id", "segment"), "segment", "left").withColumn("segment", F.coalesce("root", "segment")).drop("root")
    moved = cut(moved)
    return moved, cut(_fits(moved, ["survey", "polarity", "segment"]))


def without_echoes(lines: DataFrame) -> DataFrame:
    """Lines that aren't the bright rim of a dark one, nor a dark rim of a far stronger bright one."""
    reach = line_filter.FLANK_M + 0.1
    ux, uy = F.cos("q.angle"), F.sin("q.angle")
    dx, dy = F.col("p.cx") - F.col("q.cx"), F.col("p.cy") - F.col("q.cy")
    parallel = F.abs(F.cos(F.col("p.angle") - F.col("q.angle"))) >= math.cos(math.radians(12))
    beside = (F.col("p.polarity") != F.col("q.polarity")) & parallel & (F.abs(dy * ux - dx * uy) <= reach) & (F.abs(dx * ux + dy * uy) <= F.col("q.length") / 2)
    weaker = F.when(F.col("p.polarity") == "bright", F.col("q.length") >= 0.5 * F.col("p.length")).otherwise(F.col("q.strength") > 2 * F.col("p.strength"))
    body = F.struct(*lines.columns)
    # A line is spread over the metres of track beside it, so the pairs come from an equi-join.
    half = F.col("length") / 2 + reach
    wide = lines.withColumn("k", F.explode(F.sequence(F.floor(F.col("cy") - half), F.floor(F.col("cy") + half)))).select("survey", "k", body.alias("q"))
    own = lines.select("survey", F.floor("cy").alias("k"), body.alias("p"))
    echo = own.join(wide, ["survey", "k"]).where(beside & weaker).select(F.col("p.survey").alias("survey"), F.col("p.segment").alias("segment"))
    return lines.join(echo.distinct(), ["survey", "segment"], "left_anti")


def _joints(pdf: pd.DataFrame) -> pd.DataFrame:
    """The spacing of the lines in runs of three or more with even spacing, longest runs first; a survey has few
    such lines. Means and deviations of all runs from a line come from running sums."""
    pdf = pdf.sort_values(["cy", "segment"]).reset_index(drop=True)
    gaps = np.diff(pdf["cy"].to_numpy())
    spacing = np.full(len(pdf), np.nan)
    start = 0
    while start < len(pdf) - 2:
        count = np.arange(1, len(gaps) - start + 1)
        mean = np.cumsum(gaps[start:]) / count
        spread = np.sqrt(np.maximum(0, np.cumsum(gaps[start:] ** 2) / count - mean * mean))
        even = np.flatnonzero((count >= 2) & (mean >= LEAST_JOINT_M) & (mean <= MOST_JOINT_M) & (spread <= JOINT_SPREAD * mean))
        if len(even):
            end = start + int(even[-1]) + 1
            spacing[start : end + 1] = mean[even[-1]]
            start = end
        start += 1
    return pd.DataFrame({"survey": pdf["survey"], "segment": pdf["segment"], "joint_spacing_m": spacing}).dropna()


def following_boat(points: DataFrame, sides: DataFrame, pitch: float) -> DataFrame:
    """(survey, segment) of lines that keep their distance from the boat while it weaves between the banks: a line of
    the lining would move against the boat as the banks do. Told only where both banks are seen beside ten rows."""
    at = points.groupBy("survey", "segment", "j").agg(F.avg("x").alias("offset"))
    banks = sides.where("not empty and not open").groupBy("survey", "ping").agg(F.max("along").alias("along"), *[F.max(F.when(F.col("side") == k, F.col("waterline"))).alias(n) for k, n in ((0, "_port"), (1, "_starboard"))])
    weave = banks.where("_port is not null and _starboard is not null").groupBy("survey", F.floor(F.col("along") / pitch).alias("j")).agg(F.avg((F.col("_port") - F.col("_starboard")) / 2).alias("wobble"))
    moved = robust.regression_test(at.join(weave, ["survey", "j"]), ["survey", "segment"], "wobble", "offset", LEAST_ROWS)
    return moved.where((F.col("x_spread") >= LEAST_WOBBLE_M) & (F.col("slope") < LEAST_SLOPE)).select("survey", "segment")


def screen(pings: DataFrame, sides: DataFrame, reference: DataFrame, spans: DataFrame, sensitivity: float = 0.5, least_m: float = 0.6, draft_m: float = 0.2, stretch_m: float = STRETCH_M) -> DataFrame:
    """The candidates of all surveys, ranked; sides as settled by the canal model."""
    pitch = row_pitch(pings)
    high = 6 - 3 * sensitivity
    pixels = ridge_pixels(pings, sides, reference, spans, pitch, sensitivity, draft_m, stretch_m)
    pixels = cut(pixels)
    points, fitted = segments(pixels, pitch, sensitivity)
    points, lines = merged_lines(points, fitted, 0.5, 0.08)
    points, lines = merged_lines(points, lines, 2.5, max(0.08, 1.5 * pitch), F.abs(F.sin("angle")) < math.sin(math.radians(20)))
    kept = cut(without_echoes(lines).where((F.col("length") >= least_m) & (F.col("rms") <= MOST_RMS_M)))
    steep = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.sin("angle")))))
    kept = kept.withColumn("angle_deg", F.floor(steep + 0.5).cast("int")).withColumn("direction", text.direction_class(steep))
    joints = kept.where("direction = 'across' and polarity = 'dark'").select("survey", "segment", "cy").groupBy("survey").applyInPandas(_joints, "survey string, segment long, joint_spacing_m double")
    named = kept.join(joints, ["survey", "segment"], "left").withColumn("side", text.side_class(F.col("x1"), F.col("x2")))
    named = named.withColumn("side", F.when(F.col("side") == "both", "both").when(F.col("cx") >= 0, "port").otherwise("starboard"))
    toes = sides.groupBy("survey", "side").agg(F.percentile("toe", 0.5).alias("_toe")).withColumn("side", F.when(F.col("side") == 0, "port").otherwise("starboard"))
    named = named.join(toes, ["survey", "side"], "left")
    boat = following_boat(points, sides, pitch).withColumn("_boat", F.lit(True))
    named = named.join(boat, ["survey", "segment"], "left").where("direction <> 'along' or _boat is null").drop("_boat")
    across = profiles(named.where("direction = 'along'"), pings, sides, reference, spans, pitch, draft_m)
    named = described(cut(named), cut(across))
    near = F.coalesce((F.col("direction") == "along") & (F.abs(F.abs("cx") - F.col("_toe")) < 0.8), F.lit(False))
    level = text.confidence_class(F.col("contrast"), F.lit(high), near)
    scored = named.withColumn("confidence", level).withColumn("near_toe", near).withColumn("score", F.col("contrast") * F.sqrt(F.col("length") / 0.3))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(rank, F.desc("score"), "segment"))
    return scored.select(
        "survey", number.alias("id"), F.when(F.col("joint_spacing_m").isNotNull(), "joint").otherwise(F.col("kind")).alias("kind"), "detail", "size_cm", "width_m", "joint_spacing_m", "polarity", "direction", "angle_deg", F.col("length").alias("length_m"),
        "side", F.abs("cx").alias("offset_m"), F.col("cy").alias("along_m"), "score", "contrast", "confidence", "near_toe", "x1", "y1", "x2", "y2",
    )


def shown(found: DataFrame, low: bool = False, chosen: list[int] | None = None) -> DataFrame:
    """The candidates on view: those of low confidence only if asked for, or if their id is among the chosen."""
    sure = F.coalesce(F.col("confidence") != "low", F.lit(True))
    return found if low else found.where(sure | F.col("id").isin(chosen or []))


def placed(candidates: DataFrame, pings: DataFrame) -> DataFrame:
    """candidates with lonlat, their two ends on the map: each end hangs on the ping nearest along the track, the earlier one
    of two as near, however wide the gap; null in a survey without pings."""
    ends = candidates.withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("o"), F.col(f"y{k}").alias("along")) for k in (1, 2)]))).select("survey", "id", "e.k", "e.o", "e.along")
    near = asof.nearest_in_time(ends, pings, ["survey"], "along", ["x", "y", "hx", "hy", "lon0", "lat0"], ["ping"])
    x, y = F.col("near.x") - F.col("o") * F.col("near.hy"), F.col("near.y") + F.col("o") * F.col("near.hx")
    spot = F.array(geo.lon_of(x, F.col("near.lon0"), F.col("near.lat0")), geo.lat_of(y, F.col("near.lat0")))
    both = near.where("near is not null").groupBy("survey", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", spot.alias("s")))), lambda v: v["s"]).alias("lonlat"))
    return candidates.join(both, ["survey", "id"], "left")


def candidates_geojson(found: DataFrame) -> DataFrame:
    """(survey, geojson): a LineString for each placed candidate."""
    body = F.struct("id", "kind", "polarity", "direction", "angle_deg", F.round("length_m", 2).alias("length_m"), "side", F.round("offset_m", 2).alias("offset_m"), F.round("along_m", 2).alias("along_m"), F.round("score", 2).alias("score"), "confidence")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("lonlat").alias("coordinates")).alias("geometry"), body.alias("properties")))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))), lambda v: v["f"])
    return found.groupBy("survey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(all_of, ","), F.lit("]}")).alias("geojson"))
