"""Order statistics, robust filters and sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathom.operators.skew import lookup
from fathom.session import cut


def quantile(x: Column | str, p: float) -> Column:
    """Exact, with linear interpolation at (n-1)*p; null when empty."""
    return F.percentile(x, p)


def upper_median(x: Column | str, over: WindowSpec | None = None) -> Column:
    """The element at n div 2 of the sorted values, for keys of few rows (see order_statistics for others)."""
    held = F.collect_list(x)
    items = F.array_sort(held.over(over) if over else held)
    return F.try_element_at(items, (F.floor(F.size(items) / 2) + 1).cast("int"))


def index_percentile(x: Column | str, p: float) -> Column:
    """The sorted element at min(n-1, floor(n*p)), for keys of few rows (see order_statistics for others)."""
    items = F.array_sort(F.collect_list(x))
    n = F.size(items)
    return F.try_element_at(items, (F.least(n - 1, F.floor(n * p)) + 1).cast("int"))


def order_statistics(df: DataFrame, keys: list[str], value: str | Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, names of ranks): for each name the sorted value at the place (from 0) that its function gives for n.

    Equal values are counted first and the places come from running sums, so that no key's values are
    ever held in one array. Nulls are left out; a key without values has no row.
    """
    counts = df.select(*keys, (F.col(value) if isinstance(value, str) else value).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_run", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    found = [F.min(F.when(F.col("_run") > F.floor(place(F.col("_n"))), F.col("_v"))).alias(name) for name, place in ranks.items()]
    return run.groupBy(*keys).agg(*found)


def part_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """(keys, names of shares): exact quantiles with linear interpolation at (n-1)*p, as quantile(), for keys of very many values.

    Equal values are counted first. A sketch cuts each key's distinct values into some 64 parts; their exact counts tell in which part
    a rank lies, and only that part's values are ordered. So no buffer holds a key's values, and no task orders them all.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    counts = cut(df.select(key.alias("_key"), F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy("_key", "_v").agg(F.count("*").alias("_c")))
    sketch = counts.groupBy("_key").agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 1000).alias("_cuts"), F.count("*").alias("_rows"))
    sketch = cut(sketch)
    size = sketch.agg(F.count("*").alias("n"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows")).first()
    placed = lookup(counts, sketch, "_key", size["n"], 64 + 8 * parts, "_rows", size["rows"])
    placed = cut(placed.select("_key", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part")))
    w = Window.partitionBy("_key")
    sums = placed.groupBy("_key", "_part").agg(F.sum("_c").alias("_held"))
    sums = sums.withColumn("_before", F.sum("_held").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_held")).withColumn("_n", F.sum("_held").over(w))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), f((F.col("_n") - 1) * p).cast("long").alias("rank"), F.lit(side).alias("side")) for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = sums.withColumn("_r", F.explode(ranks)).where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_held")))
    run = F.sum("_c").over(Window.partitionBy("_key", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    needed = placed.join(wanted.select("_key", "_part").distinct(), ["_key", "_part"], "left_semi").withColumn("_run", run)
    hit = needed.join(wanted, ["_key", "_part"]).where((F.col("_r.rank") < F.col("_before") + F.col("_run")) & (F.col("_r.rank") >= F.col("_before") + F.col("_run") - F.col("_c")))
    ends = [F.max(F.when((F.col("_r.name") == name) & (F.col("_r.side") == side), F.col("_v"))).alias(f"_{side}_{name}") for name in shares for side in ("low", "high")]
    found = hit.groupBy("_key").agg(F.max("_n").alias("_n"), *ends)
    between = [(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * ((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p))).alias(name) for name, p in shares.items()]
    return found.select(*([F.col(f"_key.{k}").alias(k) for k in keys]), *between)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def share_of(p: float) -> Callable[[Column], Column]:
    return lambda n: F.least(n - 1, F.floor(n * p))


def histogram_quantile(df: DataFrame, keys: list[str], value: str, q: float, top: int = 255) -> DataFrame:
    """(keys, level): the smallest rounded, clamped level whose cumulative count exceeds q*n.

    Levels are counted first, so the window sees at most top+1 rows for each key.
    """
    level = F.least(F.greatest(F.floor(F.col(value) + 0.5), F.lit(0)), F.lit(top)).cast("int")
    counts = df.groupBy(*keys, level.alias("level")).count()
    w = Window.partitionBy(*keys)
    running = F.sum("count").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("running", running).withColumn("n", F.sum("count").over(w)).where(F.col("running") > q * F.col("n")).groupBy(*keys).agg(F.min("level").alias("level"))


def rows_around(keys: list[str], order: list[str], before: int, after: int | None = None) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, before if after is None else after)


def rolling_median(value: str | Column, keys: list[str], order: list[str], half: int) -> Column:
    """Exact, over the rows within half of each row; nulls are skipped, edges are clipped."""
    return F.percentile(value, 0.5).over(rows_around(keys, order, half))


def moving_average(value: str | Column, keys: list[str], order: list[str], half: int) -> Column:
    return F.avg(value).over(rows_around(keys, order, half))


def symmetric_average(value: str | Column, keys: list[str], order: list[str], half: int) -> Column:
    """The mean over as many rows on either side, at most half: windows shrink at both ends alike, which so stay in place."""
    w = Window.partitionBy(*keys)
    near = F.collect_list(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(float("nan")))).over(rows_around(keys, order, half))
    before = F.least(F.row_number().over(w.orderBy(*order)) - 1, F.lit(half))
    each = F.least(before, F.size(near) - 1 - before)
    some = F.slice(near, before - each + 1, 2 * each + 1)
    return F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / (2 * each + 1)


def outline_median(value: str | Column, keys: list[str], order: list[str], half: int = 2) -> Column:
    """The upper median of the rows within half of each row, clipped at the ends."""
    return upper_median(value, rows_around(keys, order, half))


def despike(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 7, floor: float = 0.5, share: float = 0.25) -> DataFrame:
    """Rows within max(floor, share*median) of the rolling median."""
    med = rolling_median(value, keys, order, half)
    near = F.abs(F.col(value) - F.col("_median")) <= F.greatest(F.lit(floor), share * F.col("_median"))
    return df.withColumn("_median", med).where(near).drop("_median")


def mad_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with z: the distance from the key's upper median in robust standard deviations; null where they are 0."""
    centre = order_statistics(df, keys, value, {"_centre": upper_middle})
    with_centre = df.join(centre, keys)
    spread = order_statistics(with_centre, keys, F.abs(F.col(value) - F.col("_centre")), {"_half": upper_middle}).select(*keys, (1.4826 * F.col("_half")).alias("_spread"))
    z = F.when(F.col("_spread") > 0, (F.col(value) - F.col("_centre")) / F.col("_spread"))
    return with_centre.join(spread, keys).withColumn("z", z).drop("_centre", "_spread")


def change_point(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 3) -> DataFrame:
    """(keys, at, gain, n): where two straight lines fit the series best, and the share of the squared error they save.

    The sums of both sides follow from running sums, so a key costs one sort.
    """
    w = Window.partitionBy(*keys)
    run = w.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.col("_x"), F.col("_y")
    base = df.withColumn("_x", (F.row_number().over(w.orderBy(*order)) - 1).cast("double")).withColumn("_y", F.col(value).cast("double"))
    parts = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    summed = base.select(*keys, "_x", *[F.sum(e).over(run).alias(f"l_{k}") for k, e in parts.items()], *[F.sum(e).over(w).alias(f"t_{k}") for k, e in parts.items()])

    def error(side: dict[str, Column]) -> Column:
        sxx = side["xx"] - side["x"] * side["x"] / side["n"]
        sxy = side["xy"] - side["x"] * side["y"] / side["n"]
        syy = side["yy"] - side["y"] * side["y"] / side["n"]
        return F.greatest(syy - F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0), F.lit(0.0))

    left = {k: F.col(f"l_{k}") for k in parts}
    whole = {k: F.col(f"t_{k}") for k in parts}
    right = {k: whole[k] - left[k] for k in parts}
    inner = summed.where((left["n"] >= least) & (whole["n"] - left["n"] >= least)).withColumn("_whole", error(whole)).withColumn("_both", error(left) + error(right))
    best = inner.where("_whole > 0").groupBy(*keys).agg(F.min_by(F.struct("_x", "_both", "_whole", "t_n"), F.struct(F.round("_both", 6), "_x")).alias("b"))
    return best.select(*keys, (F.col("b._x") + 1).cast("long").alias("at"), (1 - F.col("b._both") / F.col("b._whole")).alias("gain"), F.col("b.t_n").cast("long").alias("n"))


def regression_test(df: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """(keys, n, covariance, slope, spread, x_spread): population moments, for keys with enough rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("covariance"), F.var_pop(x).alias("_var"), F.stddev_pop(y).alias("spread"), F.stddev_pop(x).alias("x_spread"))
    return out.where(F.col("n") >= least).withColumn("slope", F.when(F.col("_var") > 0, F.col("covariance") / F.col("_var"))).drop("_var")
