"""Fixes of several logs as one track, and the clock offset that lays it over the sonar's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import distance_m, valid_position
from fathom.operators import asof, sample
from fathom.operators import track as long_track

LEAST_FIXES = 10
LEAST_POSITIONS = 20
SAMPLES = 240
GAP_S = 2.0
AGREEMENT_M = 8.0
LEAST_COVERAGE, MOST_P90_M = 0.7, 12.0
KEY = ["survey"]


def survey_key(df: DataFrame) -> DataFrame:
    """df with a survey column; a constant one where there is none."""
    return df if "survey" in df.columns else df.withColumn("survey", F.lit("survey"))


def combine_fixes(fixes: DataFrame) -> DataFrame:
    """One fix for each GPS time, the first log's where several have it; t counts from the survey's first.

    Surveys with fewer than ten different times give none.
    """
    once = sample.first_of_each(survey_key(fixes), ["survey", F.col("absolute_t").alias("_t")], ["log_ordinal", "byte_offset"])
    w = Window.partitionBy(*KEY)
    held = once.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= LEAST_FIXES).drop("_n")
    return held.withColumn("gps_origin", F.min("absolute_t").over(w)).withColumn("t", F.col("absolute_t") - F.col("gps_origin"))


def primary_positions(frames: DataFrame) -> DataFrame:
    """The primary channel's frames with a valid position; t in seconds of the recording's clock."""
    return survey_key(frames).where((F.col("channel") == 0) & valid_position(F.col("lon"), F.col("lat"))).withColumn("t", F.col("time_ms") / 1000)


def offsets(start: Column, stop: Column, step: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((stop - start) / step).cast("int")), lambda i: start + i * step)


def find_alignment(frames: DataFrame, track: DataFrame) -> DataFrame:
    """(survey, trusted, offset_s, median_position_error_m, p90_position_error_m, gps_coverage_fraction, reason).

    At most 240 evenly spaced positions meet the track at offsets 5 s apart over the whole range of
    overlap; then at offsets .25 s apart around the best. A finer offset counts only if it is better.
    """
    primary = primary_positions(frames)
    counted = survey_key(frames).select("survey").distinct().join(primary.groupBy("survey").count(), "survey", "left")
    enough = primary.join(counted.where(F.col("count") >= LEAST_POSITIONS).select("survey"), "survey", "left_semi")
    picked = sample.even_sample(enough, KEY, ["time_ms", "offset"], SAMPLES).select("survey", "t", "lon", "lat")
    about = picked.groupBy("survey").agg(F.percentile("lat", 0.5).alias("lat0"), F.min("t").alias("first"), F.max("t").alias("last"))
    ends = track.groupBy("survey").agg(F.max("t").alias("track_end"))
    points = picked.join(about, "survey").join(ends, "survey")
    line = track.withColumn("ordinal", F.struct("log_ordinal", "byte_offset"))
    start = -F.greatest(F.lit(900.0), F.col("last") - F.col("first") + 60)
    stop = F.col("track_end") - F.col("first") + 35
    coarse = asof.best_offset(asof.score_offsets(points, line, KEY, F.when(stop >= start, offsets(start, stop, 5.0)), GAP_S), KEY)
    near = points.join(coarse.select("survey", F.col("offset").alias("around")), "survey")
    around = F.col("around")
    fine = asof.best_offset(asof.score_offsets(near, line, KEY, offsets(around - 5, around + 5.001, 0.25), GAP_S), KEY)
    both = coarse.withColumn("finer", F.lit(0)).unionByName(fine.withColumn("finer", F.lit(1)))
    names = ["offset", "coverage", "p50", "p90"]
    best = both.groupBy("survey").agg(F.min_by(F.struct(*names), F.struct("score", "finer", "offset")).alias("b")).select("survey", "b.*")
    trusted = (F.col("coverage") >= LEAST_COVERAGE) & (F.col("p90") <= MOST_P90_M)
    reason = (
        F.when(F.coalesce(F.col("count"), F.lit(0)) < LEAST_POSITIONS, "too few sonar positions")
        .when(F.col("offset").isNull(), "no overlapping track")
        .when(trusted, "both tracks agree")
        .otherwise("failed accuracy or coverage")
    )
    return counted.join(best, "survey", "left").select(
        "survey",
        F.coalesce(trusted, F.lit(False)).alias("trusted"),
        F.col("offset").alias("offset_s"),
        F.col("p50").alias("median_position_error_m"),
        F.col("p90").alias("p90_position_error_m"),
        F.col("coverage").alias("gps_coverage_fraction"),
        reason.alias("reason"),
    )


def interpolator(track_rows: int | None) -> Callable[..., DataFrame]:
    """asof.interpolate, or with track_rows the one that spreads a survey's track over tasks of so many rows."""
    return partial(long_track.interpolate, rows=track_rows) if track_rows else asof.interpolate


def resolve_positions(pings: DataFrame, frames: DataFrame, track: DataFrame, sync: DataFrame, track_rows: int | None = None) -> DataFrame:
    """pings (survey, t, lon, lat, ...) with sl3_lon, sl3_lat, bin_lon, bin_lat, difference_m, pos_lon, pos_lat, gps_source.

    The track's position counts where fixes no more than two seconds apart bracket the ping and it
    lies within eight metres of the sonar's primary track; else the sonar's own.
    """
    known = sync.select("survey", "trusted", "offset_s")
    order = ["offset"] if "offset" in frames.columns else ["time_ms"]
    interpolate = interpolator(track_rows)
    own = interpolate(pings, primary_positions(frames), KEY, "t", ["lon", "lat"], order, GAP_S, "_p_")
    own = own.withColumn("sl3_lon", F.coalesce("_p_lon", "lon")).withColumn("sl3_lat", F.coalesce("_p_lat", "lat")).drop("_p_lon", "_p_lat")
    # One row for each survey: its size is the number of recordings, so Spark may choose to broadcast it.
    timed = own.join(known, "survey", "left").withColumn("_sonar_t", F.col("t")).withColumn("t", F.when(F.col("trusted"), F.col("t") + F.col("offset_s")))
    both = interpolate(timed, track, KEY, "t", ["lon", "lat"], ["log_ordinal", "byte_offset"], GAP_S, "bin_")
    both = both.withColumn("t", F.col("_sonar_t")).drop("_sonar_t", "trusted", "offset_s")
    valid = valid_position(F.col("sl3_lon"), F.col("sl3_lat"))
    both = both.withColumn("sl3_valid", valid).withColumn("difference_m", F.when(valid, distance_m(F.col("sl3_lon"), F.col("sl3_lat"), F.col("bin_lon"), F.col("bin_lat"))))
    use = F.coalesce(F.col("difference_m") <= AGREEMENT_M, F.lit(False))
    return (
        both.withColumn("pos_lon", F.when(use, F.col("bin_lon")).when(valid, F.col("sl3_lon")))
        .withColumn("pos_lat", F.when(use, F.col("bin_lat")).when(valid, F.col("sl3_lat")))
        .withColumn("gps_source", F.when(use, "ardupilot_bin").when(valid, "sl3_embedded").otherwise("missing"))
    )


def scan_points(frames: DataFrame, track: DataFrame, sync: DataFrame, most: int = 8, apart_s: float = 30.0) -> DataFrame:
    """(survey, t, lon, lat, number): up to eight matched positions far from each other, by time."""
    matched = resolve_positions(primary_positions(frames).select("survey", "offset", "t", "lon", "lat"), frames, track, sync).where("gps_source = 'ardupilot_bin'")
    flat = matched.select("survey", "t", F.col("pos_lon").alias("lon"), F.col("pos_lat").alias("lat"))
    scaled = flat.withColumn("x", F.col("lon") * 111_320 * F.cos(F.radians("lat"))).withColumn("y", F.col("lat") * 111_320)
    chosen = sample.farthest_points(scaled, KEY, "x", "y", "t", most, apart_s)
    return sample.ordinal(chosen.drop("x", "y"), KEY, ["t"], "number")
