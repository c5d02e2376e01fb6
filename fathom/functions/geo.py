"""Positions and clocks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_DEGREE = 111_320.0
MERCATOR_RADIUS = 6_356_752.3142
FEET_TO_METRES = 0.3048
GPS_UTC_LEAP_SECONDS = 18
GPS_EPOCH_UNIX = 315_964_800
WEEK_MS = 604_800_000
CHANNEL_NAMES = {0: "primary", 2: "downscan", 5: "sidescan"}


def seconds(ts: str) -> Column:
    """A timestamp without zone as seconds since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / 1e6


def finite(x: Column) -> Column:
    """x, or null for NaN and the infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def valid_position(lon: Column, lat: Column) -> Column:
    """True for finite positions on the globe other than (0, 0); never null."""
    ok = (F.abs(finite(lon)) <= 180) & (F.abs(finite(lat)) <= 90) & ((lon != 0) | (lat != 0))
    return F.coalesce(ok, F.lit(False))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat0: Column | None = None) -> Column:
    """Metres on a local plane whose scale is taken at lat0, or at the first point."""
    x = (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians(lat1 if lat0 is None else lat0))
    y = (lat1 - lat2) * METRES_PER_DEGREE
    return F.sqrt(x * x + y * y)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.pi() / 2)


def local_x(lon: Column, lon0: Column, lat0: Column) -> Column:
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0))


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * METRES_PER_DEGREE


def lon_of(x: Column, lon0: Column, lat0: Column) -> Column:
    return lon0 + x / (METRES_PER_DEGREE * F.cos(F.radians(lat0)))


def lat_of(y: Column, lat0: Column) -> Column:
    return lat0 + y / METRES_PER_DEGREE


def along_axis(x: Column, y: Column, angle: Column) -> Column:
    return x * F.cos(angle) + y * F.sin(angle)


def across_axis(x: Column, y: Column, angle: Column) -> Column:
    return y * F.cos(angle) - x * F.sin(angle)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as a long; the grid keys use this."""
    return F.floor(x + 0.5)


def gps_milliseconds(gps_seconds: Column) -> Column:
    return half_up(finite(gps_seconds) * 1000)


def gps_week(gps_seconds: Column) -> Column:
    return F.floor(gps_milliseconds(gps_seconds) / WEEK_MS)


def gps_week_ms(gps_seconds: Column) -> Column:
    return F.pmod(gps_milliseconds(gps_seconds), F.lit(WEEK_MS))


def gps_to_utc_text(gps_seconds: Column) -> Column:
    """ISO time in UTC with milliseconds, independent of the session's zone."""
    ms = gps_milliseconds(gps_seconds) + (GPS_EPOCH_UNIX - GPS_UTC_LEAP_SECONDS) * 1000
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(ms, F.lit(86_400_000))
    part = [F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000]
    return F.concat(day, F.format_string("T%02d:%02d:%02d.%03dZ", *[p.cast("long") for p in part]))


def ground_range(r: Column, height: Column, draft: Column, toe: Column, waterline: Column) -> Column:
    """Slant to ground range over a flat bed and, beyond the toe, a straight bank up to the waterline.

    A null toe means open water, whose reach then stands in for the waterline. Points above the bed,
    or beyond what the section holds, are null.
    """
    depth = height + draft
    flat = F.when(r >= height, F.sqrt(r * r - height * height))
    # On the bank z = (x - toe) * slope above the bed; x*x + (height - z)^2 = r*r.
    slope = depth / (waterline - toe)
    k = height + slope * toe
    a = 1 + slope * slope
    b = -2 * slope * k
    c = k * k - r * r
    disc = b * b - 4 * a * c
    bank = F.when(disc >= 0, (-b + F.sqrt(disc)) / (2 * a))
    return F.when(toe.isNull(), F.when(flat <= waterline, flat)).when(flat <= toe, flat).when((bank >= toe) & (bank <= waterline), bank)


def shadow_height(height: Column, far: Column, shadow_end: Column, rounds: int = 4) -> tuple[Column, Column]:
    """(ground distance of the top, object height) from a shadow between slant range far and ground distance shadow_end."""
    h = F.lit(0.0)
    y = F.sqrt(F.greatest(far * far - height * height, F.lit(0.0)))
    for _ in range(rounds):
        y = F.sqrt(F.greatest(far * far - (height - h) * (height - h), F.lit(0.0)))
        h = F.least(F.greatest(height * (shadow_end - y) / shadow_end, F.lit(0.0)), 0.9 * height)
    return y, h
