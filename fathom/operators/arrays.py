"""Sample arrays: halves, means, smoothing, sliding references, resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, **values: Column) -> DataFrame:
    """df with the named values, each computed once for each row. A plain projection would be merged into those that
    follow, and a value that these use inside a function of array elements would be computed again for every element."""
    made = F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    return df.select(*[c for c in df.columns if c not in values], made)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative op, in doubling steps: n log n work, nothing is appended."""

    def totals(first: Column) -> Column:
        steps = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(first), F.lit(2))))).cast("int")
        backs = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(backs, first, lambda acc, back: F.transform(acc, lambda x, i: F.when(i >= back, op(F.get(acc, i - back), x)).otherwise(x)))

    return let(values, totals)


def bytes_of(samples: Column) -> Column:
    """The bytes of a binary column as an array of numbers: each byte is one Latin-1 character, whose code point it is."""
    held = F.decode(samples, "ISO-8859-1")
    return F.when(F.length(held) > 0, F.transform(F.split(held, ""), lambda c: F.ascii(c))).when(held.isNotNull(), F.expr("cast(array() as array<int>)"))


def split_halves(samples: Column) -> tuple[Column, Column]:
    """(port, starboard): the first half reversed, and the next as many; an odd last sample is dropped."""
    half = F.floor(F.size(samples) / 2).cast("int")
    return F.reverse(F.slice(samples, F.lit(1), half)), F.slice(samples, half + 1, half)


def mean_of(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(samples) > 0, total / F.size(samples))


def smooth(samples: Column, half: int) -> Column:
    """Centred means over half samples to either side, shrinking at the edges."""
    n = F.size(samples)

    def at(_: Column, i: Column) -> Column:
        low, high = F.greatest(i - half, F.lit(0)), F.least(i + half, n - 1)
        return F.aggregate(F.slice(samples, low + 1, high - low + 1), F.lit(0.0), lambda s, x: s + x.cast("double")) / (high - low + 1)

    return F.transform(samples, at)


def sliding_reference(df: DataFrame, keys: list[str], ordinal: str, samples: str, half: int, name: str = "reference") -> DataFrame:
    """(keys, ordinal, name): for each position, the mean of the positive samples at that position in the rows
    whose ordinal lies within half; 0 where there are none. Dropped rows leave gaps that stay gaps."""
    each = df.select(*keys, ordinal, F.posexplode(samples).alias("_at", "_v"))
    w = Window.partitionBy(*keys, "_at").orderBy(ordinal).rangeBetween(-half, half)
    mean = F.coalesce(F.avg(F.when(F.col("_v") > 0, F.col("_v").cast("double"))).over(w), F.lit(0.0))
    held = each.withColumn("_m", mean).groupBy(*keys, ordinal).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_l"))
    return held.select(*keys, ordinal, F.transform("_l", lambda x: x["_m"]).alias(name))


def resample(samples: Column, most: int) -> Column:
    """At most `most` samples, evenly spaced by index."""
    n = F.size(samples)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(samples, (F.floor(i * (n - 1) / (most - 1)) + 1).cast("int")))
    return F.when(n <= most, samples).otherwise(picks)


def order_statistic(samples: Column, q: float) -> Column:
    """The sorted sample at floor(q*n), for q below 1; null when empty."""
    n = F.size(samples)
    return F.when(n > 0, F.element_at(F.array_sort(samples), (F.floor(q * n) + 1).cast("int")))
