"""Text formats of reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.geo import finite


def xml_text(s: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(mark), F.lit(name))
    return s


def degrees_text(x: Column) -> Column:
    return F.format_string("%.7f", x.cast("double"))


def number_text(x: Column) -> Column:
    """A number as plain digits without a trailing .0; empty for null and non-finite values."""
    d = finite(x)
    whole = d == F.floor(d)
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(whole & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(plain), F.lit(""))


def csv_cell(x: Column, kind: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) if kind in ("string", "int", "bigint") else number_text(x)


def file_stem(name: Column) -> Column:
    """The name without its sonar ending, and with runs of unusual characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.sl3$", ""), r"[^A-Za-z0-9_.-]+", "_")


def duration_text(s: Column) -> Column:
    whole = F.floor(s + 0.5).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def direction_class(angle_deg: Column) -> Column:
    """along, across or diagonal, by the angle to the track (0 to 90)."""
    return F.when(angle_deg <= 20, "along").when(angle_deg >= 70, "across").otherwise("diagonal")


def confidence_class(score: Column, high: Column, near_toe_along: Column) -> Column:
    level = F.when(score >= 1.8 * high, "high").when(score >= 1.35 * high, "medium").otherwise("low")
    return F.when(near_toe_along & (level == "high"), "medium").otherwise(level)


def side_class(left: Column, right: Column, edge: float = 0.3) -> Column:
    """both when the ends lie on either side beyond the edge; else by the sign of the middle."""
    both = (F.least(left, right) < -edge) & (F.greatest(left, right) > edge)
    return F.when(both, "both").when(left + right < 0, "port").otherwise("starboard")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _whole_seconds(s: Column) -> Column:
    return F.greatest(F.floor(s + 0.5), F.lit(0)).cast("long")


def long_duration_text(s: Column) -> Column:
    """As 1h 02m 03s."""
    n = _whole_seconds(s)
    return F.concat(F.floor(n / 3600).cast("string"), F.lit("h "), _two(F.floor(n % 3600 / 60)), F.lit("m "), _two(n % 60), F.lit("s"))


def clock_text(s: Column) -> Column:
    """As 2:03, or 1:02:03 from an hour on."""
    n = _whole_seconds(s)
    hours, minutes, rest = F.floor(n / 3600), F.floor(n % 3600 / 60), _two(n % 60)
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), _two(minutes), rest)).otherwise(F.concat_ws(":", minutes.cast("string"), rest))


def count_text(n: Column) -> Column:
    """With commas between thousands; a null is 0."""
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def size_text(size: Column) -> Column:
    return F.when(size >= 1e9, F.format_string("%.2f GB", size / 1e9)).otherwise(F.format_string("%.1f MB", size / 1e6))


def line_label(detail: Column, direction: Column) -> Column:
    """The short name of a line that isn't a joint."""
    return F.when(detail.startswith("open crack"), "Open crack").when(direction == "along", "Crack or step down").otherwise("Crack")


def file_role(name: Column) -> Column:
    """sonar, log, or null for a file that is neither, by its ending in either case."""
    return F.when(name.rlike(r"(?i)\.sl3$"), "sonar").when(name.rlike(r"(?i)\.bin$"), "log")


def picture_name(name: Column, channel: Column, s: Column, lon: Column, lat: Column) -> Column:
    """The file of a recording's picture: stem, channel, time and place, without those that are null; null for a null name."""
    label = F.when(channel == 5, "sidescan").when(channel == 2, "downscan")
    part = lambda x, low, high: F.when(x.isNotNull(), F.concat(F.format_string("%.5f", F.abs(x)), F.when(x < 0, low).otherwise(high)))
    time = F.replace(long_duration_text(s), F.lit(" "), F.lit(""))
    return F.when(name.isNotNull(), F.concat(F.concat_ws("_", file_stem(name), label, time, part(lat, "S", "N"), part(lon, "W", "E")), F.lit(".png")))


def route_name(name: Column, kind: str) -> Column:
    return F.concat(file_stem(name), F.lit(f"_route.{kind}"))
