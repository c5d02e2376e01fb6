"""Steps of axes and contours, and how much to exaggerate heights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The factors of a power of ten that an axis may step by, and the contour intervals in metres.
AXIS_STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)
CONTOUR_STEPS = (0.05, 0.1, 0.2, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
MOST_CONTOURS, LAST_CONTOUR = 12, 20.0


def nice_step(extent: Column, target: Column | int) -> Column:
    """The first pleasant step with which `extent` has at most about `target` parts."""
    raw = extent / target
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.coalesce(*[F.when(m * power >= raw, m * power) for m in AXIS_STEPS], 10 * power)


def contour_interval(low: Column, high: Column) -> Column:
    """The first interval that gives at most 12 contours between two depths, else 20 m."""
    extent = F.greatest(high - low, F.lit(0.01))
    return F.coalesce(*[F.when(extent / s <= MOST_CONTOURS, F.lit(s)) for s in CONTOUR_STEPS], F.lit(LAST_CONTOUR))


def default_exaggeration(width: Column, low: Column, high: Column) -> Column:
    """In halves from 1 to 20, so that the depths show over some 30 % of the width."""
    halves = F.floor(0.3 * width / F.greatest(high - low, F.lit(0.3)) * 2 + 0.5) / 2
    return F.least(F.greatest(halves, F.lit(1.0)), F.lit(20.0))
