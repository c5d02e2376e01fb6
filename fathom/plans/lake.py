"""Lake model: a grid of median depths, filled between the lines within a bounded radius."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.geo import local_x, local_y
from fathom.operators import asof, grid, robust, sample
from fathom.operators import track as long_track
from fathom.plans.align import KEY, primary_positions, resolve_positions
from fathom.session import cut

DRAFT_M = 0.2
RADIUS_M, MOST_RADIUS_M = 2.0, 5.0
MOST_CELLS = 200_000
LEAST_DEPTHS = 3
#: Where the search for the nearest sounding begins.
NEAR_M = 10.0
# A cell's source.
MEASURED, INTERPOLATED = 1, 8


@dataclass
class LakeModel:
    """soundings (survey, x, y, depth, t, gps_source), cells (survey, cell_m, i, j, depth, n, spread, source), and the largest cell_m."""

    soundings: DataFrame
    cells: DataFrame
    cell_m: float

    def coverage(self) -> DataFrame:
        area = F.first("cell_m") * F.first("cell_m")
        measured = F.count_if(F.col("source") == MEASURED)
        filled = F.count_if(F.col("source") == INTERPOLATED)
        width = (F.max("i") - F.min("i") + 3) * (F.max("j") - F.min("j") + 3)
        return self.cells.groupBy("survey").agg(
            measured.alias("measured_cells"),
            filled.alias("estimated_cells"),
            (width - measured - filled).alias("unknown_cells"),
            (measured * area).alias("sampled_area_m2"),
            (filled * area).alias("estimated_area_m2"),
            F.percentile(F.when(F.col("source") == MEASURED, F.col("spread")), 0.9).alias("depth_spread_p90"),
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
        )

    def profile(self, most: int = 1200) -> DataFrame:
        return sample.even_sample(self.soundings, KEY, ["t"], most)

    def sources(self) -> DataFrame:
        return self.soundings.groupBy("survey", "gps_source").count()


def accepted_depths(frames: DataFrame, time_range: tuple[float, float] | None = None, track_rows: int | None = None) -> DataFrame:
    """Plausible primary depths near their rolling median; the time range is closed and applied after it."""
    plausible = primary_positions(frames).where((F.col("depth_m") > 0.2) & (F.col("depth_m") < 200))
    if track_rows:
        kept = long_track.despike(plausible, KEY, "time_ms", ["offset"], "depth_m", rows=track_rows)
    else:
        kept = robust.despike(plausible, KEY, ["time_ms", "offset"], "depth_m")
    return kept if time_range is None else kept.where(F.col("t").between(*time_range))


def soundings(frames: DataFrame, track: DataFrame, sync: DataFrame, draft_m: float = DRAFT_M, time_range: tuple[float, float] | None = None, track_rows: int | None = None) -> DataFrame:
    """(survey, t, x, y, depth, gps_source, lon0, lat0): depths at resolved positions on a local plane."""
    depths = accepted_depths(frames, time_range, track_rows).select("survey", "offset", "t", "lon", "lat", "depth_m")
    origin = depths.groupBy("survey").agg(F.percentile("lon", 0.5).alias("lon0"), F.percentile("lat", 0.5).alias("lat0"))
    placed = resolve_positions(depths, frames, track, sync, track_rows).where("pos_lon is not null").join(origin, "survey")
    x, y = local_x(F.col("pos_lon"), F.col("lon0"), F.col("lat0")), local_y(F.col("pos_lat"), F.col("lat0"))
    return placed.select("survey", "t", x.alias("x"), y.alias("y"), (F.col("depth_m") + draft_m).alias("depth"), "gps_source", "lon0", "lat0")


def cell_sizes(points: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """(survey, n, cell_m): each survey's least cell of a metre or more, by steps of 1 %, with which its area and a margin fit the budget."""
    spans = points.groupBy("survey").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    first = F.greatest(F.lit(1.0), F.sqrt((F.col("max_x") - F.col("min_x") + 4) * (F.col("max_y") - F.col("min_y") + 4) / max(16, most - 1)))
    side = lambda c, s: F.ceil((F.col(f"max_{c}") - F.floor(F.col(f"min_{c}") / s) * s + s) / s) + 2
    return spans.select("survey", "n", grid.least_size(first, lambda s: side("x", s) * side("y", s) <= most).alias("cell_m"))


def lake_model(frames: DataFrame, track: DataFrame, sync: DataFrame, draft_m: float = DRAFT_M, radius_m: float = RADIUS_M, most_cells: int = MOST_CELLS, time_range: tuple[float, float] | None = None, track_rows: int | None = None) -> LakeModel:
    """The model of all surveys, each on its own cell size; with track_rows a survey's track is spread over tasks of so many rows. Cell (i, j) of a survey is centred on (i, j) times its cell_m."""
    points = cut(soundings(frames, track, sync, draft_m, time_range, track_rows))
    sizes = cut(cell_sizes(points, most_cells))
    found = sizes.agg(F.max("n").alias("n"), F.min("cell_m").alias("least"), F.max("cell_m").alias("most")).first()
    if (found["n"] or 0) < LEAST_DEPTHS:
        raise ValueError("too few depth readings with a valid position")
    sizes = sizes.drop("n")
    scaled = points.join(sizes, "survey").withColumn("u", F.col("x") / F.col("cell_m")).withColumn("v", F.col("y") / F.col("cell_m"))
    measured = grid.median_cells(scaled, "u", "v", "depth", 1.0, ["survey", "cell_m"])
    measured = measured.select("survey", "cell_m", "i", "j", F.col("value").alias("depth"), "n", "spread", F.lit(MEASURED).alias("source"))
    radius = min(MOST_RADIUS_M, max(0.0, radius_m))
    if radius < found["least"]:
        return LakeModel(points, measured, found["most"])
    # In cells, so that one fill serves all sizes; the weights' ratios are those of metres. A radius below a survey's cell fills nothing.
    held = measured.withColumn("reach", F.lit(radius) / F.col("cell_m"))
    filled = grid.idw_fill(held, 1.0, radius / found["least"], "depth", ["survey", "cell_m"], own="reach")
    filled = filled.select("survey", "cell_m", "i", "j", "depth", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("spread"), F.lit(INTERPOLATED).alias("source"))
    return LakeModel(points, measured.unionByName(filled), found["most"])


def depths_at(model: LakeModel, points: DataFrame) -> DataFrame:
    """points (survey, x, y and more) with depth: between the model's cells, or outside it that of the nearest sounding; null in a
    survey without soundings."""
    sizes = model.cells.select("survey", "cell_m").distinct()
    placed = points.join(sizes, "survey", "left").withColumn("_u", F.col("x") / F.col("cell_m")).withColumn("_v", F.col("y") / F.col("cell_m")).drop("cell_m")
    inside = cut(grid.bilinear(placed, model.cells, "_u", "_v", 1.0, "depth", "depth", KEY).drop("_u", "_v"))
    # Surveys lie apart for the search.
    apart = F.pmod(F.xxhash64("survey"), F.lit(1 << 20)) * 1e7
    open_ = inside.where("depth is null").drop("depth").withColumn("_x", F.col("x") + apart)
    known = model.soundings.select("survey", (F.col("x") + apart).alias("_x"), "y", F.struct("t", "x", "y", "depth").alias("_sounding"))
    near = asof.nearest_anywhere(open_, known, ("_x", "y"), ("_x", "y"), "_sounding", NEAR_M)
    own = F.when(F.abs(F.col("near.x") - F.col("_x")) < 5e6, F.col("near.order.depth"))
    return inside.where("depth is not null").unionByName(near.withColumn("depth", own).drop("near", "_x"))
