"""The aligned ping table, its report and summary, and the route files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import geo, text
from fathom.operators import asof, sample
from fathom.plans.align import GAP_S, KEY, primary_positions, resolve_positions, survey_key

# The table's columns, in order.
COLUMNS = [
    "ping_id", "channel_id", "channel_name", "sl3_frame_index", "sl3_frame_offset_bytes", "sonar_time_ms", "gps_week", "gps_milliseconds_of_week",
    "latitude_deg", "longitude_deg", "gps_source", "sl3_primary_latitude_deg", "sl3_primary_longitude_deg", "sl3_header_latitude_deg", "sl3_header_longitude_deg",
    "bin_latitude_deg", "bin_longitude_deg", "bin_sl3_difference_m", "recorded_depth_m", "sl3_header_depth_m", "range_min_m", "range_max_m", "sample_count",
    "raw_intensity_mean_0_255", "raw_intensity_max_0_255",
]


def sample_stats(samples: str):
    """Mean and maximum of a binary column's bytes, from its hex digits."""
    pairs = F.when(F.length(samples) > 0, F.regexp_extract_all(F.hex(samples), F.lit(".."), F.lit(0)))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + F.conv(x, 16, 10).cast("long"))
    # Pairs of digits sort like the numbers that they are.
    return total / F.length(samples), F.conv(F.array_max(pairs), 16, 10).cast("int")


def select_window(frames: DataFrame, channels: list[int], start: float = 0.0, duration: float | None = None) -> DataFrame:
    """Frames with samples of the channels, from start seconds after the survey's first ping; the end is open."""
    keyed = survey_key(frames)
    first = keyed.groupBy("survey").agg((F.min("time_ms") / 1000).alias("_first"))
    t = F.col("time_ms") / 1000 - F.col("_first")
    inside = F.col("channel").isin(channels) & (F.col("ping_size") > 0) & (t >= start)
    return keyed.join(first, "survey").where(inside if duration is None else inside & (t < start + duration)).drop("_first")


def preview(frames: DataFrame, channel: int, start: float = 0.0, seconds: float = 30.0, columns: int = 540, rows: int = 240) -> DataFrame:
    """(survey, x, y, value): a channel's echoes in a window as a picture: up to `columns` pings, evenly chosen, each
    read at `rows` evenly spaced samples. Pings are numbered without their samples, which only the chosen ones get."""
    inside = select_window(frames, [channel], start, seconds).where("ping_size > 1")
    chosen = sample.even_sample(inside.select("survey", "offset"), KEY, ["offset"], columns)
    numbered = sample.ordinal(chosen, KEY, ["offset"], "x").withColumn("x", F.col("x") - 1)
    each = inside.select("survey", "offset", "samples").join(numbered, ["survey", "offset"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    place = F.floor(F.col("y") * (F.length("samples") - 1) / (rows - 1)).cast("int") + 1
    return each.select("survey", "x", "y", F.conv(F.hex(F.substring("samples", place, F.lit(1))), 16, 10).cast("int").alias("value"))


def aligned(frames: DataFrame, track: DataFrame, sync: DataFrame, channels: list[int], start: float = 0.0, duration: float | None = None) -> DataFrame:
    """survey and the 25 columns, one row for each selected ping; frames need their samples."""
    pings = select_window(frames, channels, start, duration).withColumn("t", F.col("time_ms") / 1000)
    placed = resolve_positions(pings, frames, track, sync)
    deep = primary_positions(frames).where((F.col("depth_m") > 0) & (F.col("depth_m") < 10))
    depths = asof.interpolate(placed, deep, KEY, "t", ["depth_m"], ["offset"], GAP_S, "_at_")
    several = deep.groupBy("survey").agg((F.count("*") >= 2).alias("_several"))
    own = F.when((F.col("depth_m") > 0) & (F.col("depth_m") < 10), F.col("depth_m"))
    origin = track.groupBy("survey").agg(F.min("gps_origin").alias("_origin"))
    rows = depths.join(several, "survey", "left").join(sync.select("survey", "trusted", "offset_s"), "survey", "left").join(origin, "survey", "left")
    gps = F.when(F.col("trusted"), F.col("_origin") + F.col("t") + F.col("offset_s"))
    mean, top = sample_stats("samples")
    header = geo.valid_position(F.col("lon"), F.col("lat"))
    name = F.create_map(*[F.lit(x) for pair in geo.CHANNEL_NAMES.items() for x in pair])
    values = {
        "channel_id": F.col("channel"),
        "channel_name": F.try_element_at(name, F.col("channel")),
        "sl3_frame_index": F.col("index"),
        "sl3_frame_offset_bytes": F.col("offset"),
        "sonar_time_ms": F.col("time_ms"),
        "gps_week": geo.gps_week(gps),
        "gps_milliseconds_of_week": geo.gps_week_ms(gps),
        "latitude_deg": F.col("pos_lat"),
        "longitude_deg": F.col("pos_lon"),
        "gps_source": F.col("gps_source"),
        "sl3_primary_latitude_deg": F.when(F.col("sl3_valid"), F.col("sl3_lat")),
        "sl3_primary_longitude_deg": F.when(F.col("sl3_valid"), F.col("sl3_lon")),
        "sl3_header_latitude_deg": F.when(header, F.col("lat")),
        "sl3_header_longitude_deg": F.when(header, F.col("lon")),
        "bin_latitude_deg": F.col("bin_lat"),
        "bin_longitude_deg": F.col("bin_lon"),
        "bin_sl3_difference_m": F.col("difference_m"),
        "recorded_depth_m": F.when(F.coalesce("_several", F.lit(False)), F.col("_at_depth_m")).otherwise(own),
        "sl3_header_depth_m": geo.finite(F.col("depth_m")),
        "range_min_m": F.col("min_range_ft") * geo.FEET_TO_METRES,
        "range_max_m": F.col("max_range_ft") * geo.FEET_TO_METRES,
        "sample_count": F.col("ping_size"),
        "raw_intensity_mean_0_255": mean,
        "raw_intensity_max_0_255": top,
    }
    flat = rows.select("survey", *[v.alias(k) for k, v in values.items()])
    return sample.ordinal(flat, KEY, ["sl3_frame_offset_bytes"], "ping_id").select("survey", *COLUMNS)


def csv_lines(table: DataFrame) -> DataFrame:
    """(survey, ping_id, line): each row as text, numbers in plain digits, nulls empty."""
    kinds = dict(table.dtypes)
    return table.select("survey", "ping_id", F.concat_ws(",", *[text.csv_cell(F.col(c), kinds[c]) for c in COLUMNS]).alias("line"))


def _by_survey(df: DataFrame) -> DataFrame:
    """df with each survey in one partition, whatever Spark knows of its parts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("survey"))


def write_csv(table: DataFrame, path: str) -> None:
    """A folder survey=<name> for each survey, with its CSV in one file: the header and then the pings in order, CRLF line ends.

    The rows of a survey are dealt to one task, as a file has one writer, and sorted there (on disk if need be).
    """
    ordered = _by_survey(table).sortWithinPartitions("survey", "ping_id")
    kinds = dict(table.dtypes)
    cells = [text.csv_cell(F.col(c), kinds[c]).alias(c) for c in COLUMNS]
    ordered.select("survey", *cells).write.partitionBy("survey").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").option("quote", "\0").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder survey=<name> for each survey, with its (survey, part, at, line) in one text file, by part and at."""
    ordered = _by_survey(lines).sortWithinPartitions("survey", "part", "at")
    ordered.select("survey", F.col("line").alias("value")).write.partitionBy("survey").text(path)


def quality_report(table: DataFrame, track: DataFrame, sync: DataFrame) -> DataFrame:
    """(survey, report): the counts, fractions and notes of an aligned table, as JSON."""
    by = table.groupBy("survey", "channel_name", "gps_source").agg(F.count("*").alias("n"))
    channels = by.groupBy("survey", "channel_name").agg(F.sum("n").alias("n")).groupBy("survey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("channel_name", F.lit("other")), "n")))).alias("channels"))
    sources = by.groupBy("survey", "gps_source").agg(F.sum("n").alias("n")).groupBy("survey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gps_source", "n")))).alias("gps_sources"))
    total = table.groupBy("survey").agg(
        F.count("*").alias("exported_pings"),
        F.avg(F.isnotnull("bin_latitude_deg").cast("int")).alias("bin_temporal_coverage_fraction"),
        F.avg((F.col("gps_source") == "ardupilot_bin").cast("int")).alias("bin_position_adoption_fraction"),
        F.percentile("bin_sl3_difference_m", 0.5).alias("bin_sl3_position_difference_median_m"),
        F.percentile("bin_sl3_difference_m", 0.9).alias("bin_sl3_position_difference_p90_m"),
    )
    fixes = track.groupBy("survey").agg(F.count("*").alias("gps_fixes"))
    aligned_by = sync.select("survey", F.struct(*[c for c in sync.columns if c != "survey"]).alias("time_alignment"))
    notes = F.array(
        F.lit("GPS time is inferred from laying the two tracks over each other; it is GPS time, not UTC."),
        F.lit("A log position counts where fixes within two seconds bracket the ping and it lies within eight metres of the sonar's track."),
        F.lit("No attitude, layback or tide correction is applied."),
    )
    full = total.join(channels, "survey").join(sources, "survey").join(fixes, "survey", "left").join(aligned_by, "survey", "left").withColumn("notes", notes)
    return full.select("survey", F.to_json(F.struct(*[c for c in full.columns if c != "survey"])).alias("report"))


def recording_summary(frames: DataFrame) -> DataFrame:
    """One row for each survey: start, duration, counts by channel, medians, depth coverage, a route of 180 points."""
    f = survey_key(frames)
    ch, d, ft = F.col("channel"), F.col("depth_m"), geo.FEET_TO_METRES
    primary = ch == 0
    total = f.groupBy("survey").agg(
        (F.min("time_ms") / 1000).alias("start"),
        ((F.max("time_ms") - F.min("time_ms")) / 1000).alias("duration"),
        *[F.count_if(ch == k).alias(n) for k, n in geo.CHANNEL_NAMES.items()],
        F.percentile(F.when(primary & (d > 0) & (d < 20), d), 0.5).alias("median_depth"),
        F.percentile(F.when((ch == 5) & (F.col("max_range_ft") > 0), F.col("max_range_ft") * ft), 0.5).alias("sidescan_range_m"),
        F.coalesce(F.try_divide(F.count_if(primary & (d > 0.2) & (d < 200)), F.count_if(primary)), F.lit(0.0)).alias("depth_coverage"),
    )
    route = sample.even_sample(primary_positions(frames), KEY, ["offset"], 180).groupBy("survey").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("route"))
    start = F.greatest(F.lit(0.0), F.least(F.col("duration") - 90, F.col("duration") / 2 - 45))
    return total.join(route, "survey", "left").withColumn("preview_start", start)


def scan_times(scans: DataFrame, track: DataFrame, sync: DataFrame) -> DataFrame:
    """scans (survey, t in sonar seconds, lon, lat, number) with gps_seconds."""
    origin = track.groupBy("survey").agg(F.min("gps_origin").alias("_o"))
    return scans.join(origin, "survey").join(sync.select("survey", "offset_s"), "survey").withColumn("gps_seconds", F.col("_o") + F.col("t") + F.col("offset_s")).drop("_o", "offset_s")


def route_geojson(track: DataFrame, scans: DataFrame, name: str) -> DataFrame:
    """(survey, geojson): a LineString of the fixes, and a Point for each timed scan."""
    line = track.groupBy("survey").agg(F.array_sort(F.collect_list(F.struct("t", "lon", "lat"))).alias("p"), F.min("absolute_t").alias("first"), F.max("absolute_t").alias("last"))
    line = line.select(
        "survey",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates")).alias("geometry"),
                F.struct(F.lit(name).alias("name"), geo.gps_to_utc_text(F.col("first")).alias("start_time_utc"), geo.gps_to_utc_text(F.col("last")).alias("end_time_utc")).alias("properties"),
            )
        ).alias("line"),
    )
    g = F.col("gps_seconds")
    point = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
            F.struct(F.concat(F.lit("Scan "), "number").alias("name"), F.col("number").alias("scan"), F.col("t").alias("recording_time_s"), geo.gps_week(g).alias("gps_week"), geo.gps_week_ms(g).alias("gps_milliseconds_of_week"), geo.gps_to_utc_text(g).alias("time_utc")).alias("properties"),
        )
    )
    points = scans.groupBy("survey").agg(F.array_sort(F.collect_list(F.struct("number", point.alias("f")))).alias("s"))
    features = F.concat(F.array("line"), F.coalesce(F.transform("s", lambda x: x["f"]), F.array().cast("array<string>")))
    return line.join(points, "survey", "left").select("survey", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")).alias("geojson"))


def _gpx_point(kind: str) -> Column:
    return F.concat(F.lit(f'<{kind} lat="'), text.degrees_text(F.col("lat")), F.lit('" lon="'), text.degrees_text(F.col("lon")), F.lit('">'))


def gpx_lines(track: DataFrame, scans: DataFrame, name: str) -> DataFrame:
    """(survey, part, at, line): the GPX file of each survey line by line, for write_lines(); no task holds a track."""
    title = text.xml_text(F.lit(name))
    surveys = track.select("survey").distinct()
    fixed = lambda part, line: surveys.select("survey", F.lit(part).alias("part"), F.lit(0.0).alias("at"), line.alias("line"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">\n<metadata><name>'), title, F.lit("</name></metadata>"))
    way = F.concat(_gpx_point("wpt"), F.lit("<time>"), geo.gps_to_utc_text(F.col("gps_seconds")), F.lit("</time><name>Scan "), F.col("number").cast("string"), F.lit("</name></wpt>"))
    metres = geo.finite(F.col("altitude_m"))
    height = F.when(metres.isNotNull(), F.concat(F.lit("<ele>"), F.format_string("%.2f", metres), F.lit("</ele>"))).otherwise("")
    step = F.concat(_gpx_point("trkpt"), height, F.lit("<time>"), geo.gps_to_utc_text(F.col("absolute_t")), F.lit("</time></trkpt>"))
    return (
        fixed(0, head)
        .unionByName(scans.join(surveys, "survey", "left_semi").select("survey", F.lit(1).alias("part"), F.col("number").cast("double").alias("at"), way.alias("line")))
        .unionByName(fixed(2, F.concat(F.lit("<trk><name>"), title, F.lit("</name><trkseg>"))))
        .unionByName(track.select("survey", F.lit(3).alias("part"), F.col("t").cast("double").alias("at"), step.alias("line")))
        .unionByName(fixed(4, F.lit("</trkseg></trk>\n</gpx>")))
    )


def route_gpx(track: DataFrame, scans: DataFrame, name: str) -> DataFrame:
    """(survey, gpx): a waypoint for each timed scan and a track point for each fix."""
    g = F.col("gps_seconds")
    way = F.concat(F.lit('<wpt lat="'), text.degrees_text(F.col("lat")), F.lit('" lon="'), text.degrees_text(F.col("lon")), F.lit('"><time>'), geo.gps_to_utc_text(g), F.lit("</time><name>Scan "), F.col("number").cast("string"), F.lit("</name></wpt>"))
    ways = scans.groupBy("survey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", way.alias("x")))), lambda s: s["x"]), "\n").alias("ways"))
    height = F.coalesce(F.concat(F.lit("<ele>"), F.format_string("%.2f", geo.finite(F.col("altitude_m"))), F.lit("</ele>")), F.lit(""))
    height = F.when(geo.finite(F.col("altitude_m")).isNotNull(), height).otherwise("")
    step = F.concat(F.lit('<trkpt lat="'), text.degrees_text(F.col("lat")), F.lit('" lon="'), text.degrees_text(F.col("lon")), F.lit('">'), height, F.lit("<time>"), geo.gps_to_utc_text(F.col("absolute_t")), F.lit("</time></trkpt>"))
    line = track.groupBy("survey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", step.alias("x")))), lambda s: s["x"]), "\n").alias("steps"))
    title = text.xml_text(F.lit(name))
    return line.join(ways, "survey", "left").select(
        "survey",
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">\n<metadata><name>'),
            title,
            F.lit("</name></metadata>\n"),
            F.coalesce("ways", F.lit("")),
            F.lit("\n<trk><name>"),
            title,
            F.lit("</name><trkseg>\n"),
            F.col("steps"),
            F.lit("\n</trkseg></trk>\n</gpx>\n"),
        ).alias("gpx"),
    )
