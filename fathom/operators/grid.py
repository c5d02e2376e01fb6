"""Sparse grids: a row for each cell that has a value. Cells are numbered by rounding halves up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import half_up
from fathom.operators import robust
from fathom.operators.nearest import counted, repeats
from fathom.session import cut


def cell_of(x: Column | str, size: float) -> Column:
    return half_up((F.col(x) if isinstance(x, str) else x) / size)


def least_size(first: Column, fits: Callable[[Column], Column], steps: int = 400) -> Column:
    """The smallest of first, 1.01 first, 1.01^2 first, ... for which fits() holds; null if none of so many steps does."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: first * F.pow(F.lit(1.01), k))
    return F.get(F.filter(sizes, fits), F.lit(0))


def fitting_size(width: Column, height: Column, most: int, least: float, margin: float = 0.0, steps: int = 400) -> Column:
    """The smallest of the sizes s, 1.01 s, 1.01^2 s, ... with which an area and a margin of cells on each side has at most
    `most` cells; s is the side of as many equal squares, or `least` if that is larger. Each row has its own size."""
    first = F.greatest(F.lit(float(least)), F.sqrt(width * height / most))
    return least_size(first, lambda s: (F.ceil(width / s) + 1 + 2 * margin) * (F.ceil(height / s) + 1 + 2 * margin) <= most, steps)


def median_cells(points: DataFrame, x: str, y: str, value: str, size: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, value, n, spread): median, count and p90-p10 of each cell."""
    keys = keys or []
    return points.groupBy(*keys, cell_of(x, size).alias("i"), cell_of(y, size).alias("j")).agg(
        F.percentile(value, 0.5).alias("value"), F.count("*").alias("n"), (F.percentile(value, 0.9) - F.percentile(value, 0.1)).alias("spread")
    )


def weighted_cells(points: DataFrame, x: str, y: str, value: str, off: str, source: str, rank: str, order: str, size: float) -> DataFrame:
    """(i, j, value, source): mean by weight 1/(1+(off/5)^2); the source of the highest rank, the first among equals."""
    w = 1 / (1 + (F.col(off) / 5) * (F.col(off) / 5))
    best = F.max_by(F.col(source), F.struct(F.col(rank), -F.col(order)))
    return points.groupBy(cell_of(x, size).alias("i"), cell_of(y, size).alias("j")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("value"), best.alias("source"))


def offsets(reach: int, centre: bool = False) -> Column:
    """array<struct<di,dj>> of the square around a cell."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    pairs = F.flatten(F.transform(steps, lambda di: F.transform(steps, lambda dj: F.struct(di.alias("di"), dj.alias("dj")))))
    return pairs if centre else F.filter(pairs, lambda p: (p["di"] != 0) | (p["dj"] != 0))


def around(cells: DataFrame, reach: int, keep: list[str]) -> DataFrame:
    """(i, j, di, dj, keep...): each cell offered to the cells around it."""
    return cells.withColumn("_o", F.explode(offsets(reach))).select((F.col("i") - F.col("_o.di")).alias("i"), (F.col("j") - F.col("_o.dj")).alias("j"), F.col("_o.di").alias("di"), F.col("_o.dj").alias("dj"), *keep)


def idw_fill(cells: DataFrame, size: float, radius: float, value: str = "value", keys: list[str] | None = None, own: str | None = None) -> DataFrame:
    """(keys, i, j, value, n): cells without a value, from at least three measured ones within radius, and within the radius
    in the column `own` of cells, if named, which is the same for all cells of a key.

    The weight is 1/d^2. A cell whose neighbours leave an angle of pi-0.01 or more open lies outside
    the measured area and stays empty.
    """
    at = [*(keys or []), "i", "j"]
    reach = int(radius // size)
    d = size * F.sqrt(F.col("di") * F.col("di") + F.col("dj") * F.col("dj"))
    near = around(cells, reach, [*(keys or []), value, *([own] if own else [])]).withColumn("d", d).where(F.col("d") <= (F.least(F.lit(radius), own) if own else radius)).withColumn("angle", F.atan2(F.col("dj").cast("double"), F.col("di").cast("double")))
    empty = near.join(cells.select(*at), at, "left_anti")
    w = Window.partitionBy(*at)
    turn = F.lead("angle").over(w.orderBy("angle", "d"))
    gaps = empty.withColumn("gap", F.coalesce(turn, F.min("angle").over(w) + 2 * F.pi()) - F.col("angle"))
    weight = 1 / (F.col("d") * F.col("d"))
    filled = gaps.groupBy(*at).agg(F.count("*").alias("n"), F.max("gap").alias("gap"), (F.sum(F.col(value) * weight) / F.sum(weight)).alias("value"))
    return filled.where((F.col("n") >= 3) & (F.col("gap") < F.pi() - 0.01)).select(*at, F.col("value").alias(value), "n")


def bilinear(probes: DataFrame, cells: DataFrame, x: str, y: str, size: float, value: str = "value", name: str = "sampled", keys: list[str] | None = None) -> DataFrame:
    """probes with the value between the present corners of their four cells, weights renormalised; null without any.
    Equal probes are asked once and come back as often as they were. With keys, a grid for each key."""
    at = [*(keys or []), "i", "j"]
    u, v = F.col(x) / size, F.col(y) / size
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = counted(probes).withColumn("_c", F.explode(corners))
    fu, fv = u - F.floor(u), v - F.floor(v)
    weight = F.when(F.col("_c.a") == 1, fu).otherwise(1 - fu) * F.when(F.col("_c.b") == 1, fv).otherwise(1 - fv)
    spread = spread.select(*(keys or []), "_probe", "_times", (F.floor(u) + F.col("_c.a")).alias("i"), (F.floor(v) + F.col("_c.b")).alias("j"), weight.alias("_w"))
    joined = spread.join(cells.select(*at, F.col(value).alias("_v")), at, "left")
    has = F.when(F.col("_v").isNotNull(), F.col("_w"))
    out = joined.groupBy("_probe", "_times").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum(has).alias("_t"))
    return out.select("_probe.*", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).alias(name), F.explode(repeats()).alias("_copy")).drop("_copy")


def nearest_cell(probes: DataFrame, cells: DataFrame, x: str, y: str, size: float, value: str, name: str) -> DataFrame:
    """probes with the value of the cell they round to; null outside."""
    keyed = probes.withColumn("i", cell_of(x, size)).withColumn("j", cell_of(y, size))
    return keyed.join(cells.select("i", "j", F.col(value).alias(name)), ["i", "j"], "left").drop("i", "j")


def fill_pass(cells: DataFrame, reach4: bool = True, least: int = 2, value: str = "value", inside: tuple[int, int, int, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """cells with the empty ones that have at least `least` filled neighbours (of 4, or of 8), as their mean."""
    at = [*(keys or []), "i", "j"]
    near = around(cells, 1, [*(keys or []), value])
    if reach4:
        near = near.where(F.abs("di") + F.abs("dj") == 1)
    new = near.join(cells.select(*at), at, "left_anti").groupBy(*at).agg(F.count("*").alias("_n"), F.avg(value).alias(value)).where(F.col("_n") >= least)
    if inside:
        low_i, high_i, low_j, high_j = inside
        new = new.where(F.col("i").between(low_i, high_i) & F.col("j").between(low_j, high_j))
    return cells.select(*at, value).unionByName(new.select(*at, value))


def fill_holes(cells: DataFrame, passes: int, **how) -> DataFrame:
    """Repeated fill_pass; lineage is cut after each pass."""
    for _ in range(passes):
        cells = cut(fill_pass(cells, **how))
    return cells


def best_axis(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, angle, area): of 180 directions, the first whose bounding box (each side plus 1) is least."""
    turned = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(179))).alias("angle"))
    a = F.radians(F.col("angle").cast("double"))
    u, v = F.col("_x") * F.cos(a) + F.col("_y") * F.sin(a), F.col("_y") * F.cos(a) - F.col("_x") * F.sin(a)
    boxes = turned.groupBy(*keys, "angle").agg(((F.max(u) - F.min(u) + 1) * (F.max(v) - F.min(v) + 1)).alias("area"))
    return boxes.groupBy(*keys).agg(F.min_by(F.struct("angle", "area"), F.struct(F.round("area", 9), "angle")).alias("b")).select(*keys, "b.angle", "b.area")


def stamp(objects: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """(i, j, raised, id): heights of elliptical, flat-topped objects (x, y, half_length, half_width, heading, height, id).

    The outer fifth of an ellipse tapers to nothing; heights add up, and the highest id names the cell.
    """
    reach = F.ceil(F.greatest("half_length", "half_width") / size).cast("int")
    ci, cj = cell_of("x", size), cell_of("y", size)
    spread = objects.withColumn("di", F.explode(F.sequence(-reach, reach))).withColumn("dj", F.explode(F.sequence(-reach, reach))).withColumn("i", ci + F.col("di")).withColumn("j", cj + F.col("dj"))
    dx, dy = F.col("i") * size - F.col("x"), F.col("j") * size - F.col("y")
    u = (dx * F.cos("heading") + dy * F.sin("heading")) / F.col("half_length")
    v = (dy * F.cos("heading") - dx * F.sin("heading")) / F.col("half_width")
    r = F.sqrt(u * u + v * v)
    part = F.when(r <= 0.8, 1.0).when(r <= 1.0, (1.0 - r) / 0.2)
    return spread.withColumn("_h", F.col("height") * part).where("_h > 0").groupBy(*(keys or []), "i", "j").agg(F.sum("_h").alias("raised"), F.max("id").alias("id"))


def corners(cells: DataFrame, value: str = "value") -> DataFrame:
    """(i, j, z00, z10, z11, z01) of the squares whose four corners exist."""
    parts = [(0, 0, "z00"), (1, 0, "z10"), (1, 1, "z11"), (0, 1, "z01")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in parts]))
    spread = cells.withColumn("_c", each).select((F.col("i") - F.col("_c.a")).alias("i"), (F.col("j") - F.col("_c.b")).alias("j"), F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), F.col(value).alias("z"))
    square = spread.groupBy("i", "j").agg(F.count("*").alias("n"), *[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("z"))).alias(n) for a, b, n in parts])
    return square.where("n = 4").drop("n")


def contours(cells: DataFrame, interval: float, value: str = "value") -> DataFrame:
    """(i, j, level, x1, y1, x2, y2): marching squares in cell units; saddles give two segments in edge order."""
    sq = corners(cells, value)
    low, high = F.least("z00", "z10", "z11", "z01"), F.greatest("z00", "z10", "z11", "z01")
    first, last = F.ceil(low / interval), F.floor(high / interval)
    levels = sq.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("level", F.col("k") * interval)
    ring = [("z00", "z10", 0, 0, 1, 0), ("z10", "z11", 1, 0, 0, 1), ("z11", "z01", 1, 1, -1, 0), ("z01", "z00", 0, 1, 0, -1)]
    hits = []
    for a, b, x, y, dx, dy in ring:
        za, zb, lv = F.col(a), F.col(b), F.col("level")
        crosses = ((za < lv) & (zb >= lv)) | ((zb < lv) & (za >= lv))
        t = (lv - za) / (zb - za)
        hits.append(F.when(crosses, F.struct((F.col("i") + x + dx * t).alias("x"), (F.col("j") + y + dy * t).alias("y"))))
    found = levels.withColumn("h", F.filter(F.array(*hits), lambda p: p.isNotNull()))
    pair = F.filter(F.array(F.struct(F.get("h", F.lit(0)).alias("p"), F.get("h", F.lit(1)).alias("q")), F.struct(F.get("h", F.lit(2)).alias("p"), F.get("h", F.lit(3)).alias("q"))), lambda s: s["q"].isNotNull())
    return found.withColumn("s", F.explode(pair)).select("i", "j", "level", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def triangles(cells: DataFrame, value: str = "value") -> DataFrame:
    """(i, j, half, zs): the two triangles of each complete square."""
    sq = corners(cells, value)
    two = F.array(F.struct(F.lit(0).alias("half"), F.array("z00", "z10", "z11").alias("zs")), F.struct(F.lit(1).alias("half"), F.array("z00", "z11", "z01").alias("zs")))
    return sq.withColumn("t", F.explode(two)).select("i", "j", "t.half", "t.zs")


def ridge_thin(cells: DataFrame, low: float, z: str = "z", steps: str = "normal") -> DataFrame:
    """Cells with z >= low that are no lower than both neighbours along their normal (a struct di, dj)."""
    held = cells.where(F.col(z) >= low)
    side = F.explode(F.array(F.lit(-1), F.lit(1)))
    ask = held.withColumn("_s", side).select("i", "j", (F.col("i") + F.col("_s") * F.col(f"{steps}.di")).alias("ni"), (F.col("j") + F.col("_s") * F.col(f"{steps}.dj")).alias("nj"))
    seen = ask.join(cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col(z).alias("nz")), ["ni", "nj"], "left")
    top = seen.groupBy("i", "j").agg(F.max("nz").alias("_nz"))
    return held.join(top, ["i", "j"]).where(F.col("_nz").isNull() | (F.col(z) >= F.col("_nz"))).drop("_nz")


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, every: int = 1, order: str | None = None) -> DataFrame:
    """df with level 0..255 between two quantiles, taken from every so-many-th row by a hash of the order column."""
    base = df if every == 1 else df.where(F.pmod(F.xxhash64(order), F.lit(every)) == 0)
    ends = robust.part_quantiles(base, [], value, {"_lo": low, "_hi": high})  # one row
    scaled = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return df.join(F.broadcast(ends)).withColumn("level", F.least(F.greatest(half_up(scaled * 255), F.lit(0)), F.lit(255)).cast("int")).drop("_lo", "_hi")


def relief_range(cells: DataFrame, keys: list[str], value: str, base: str, least: float = 0.1, every: int = 3, share: float = 0.98) -> DataFrame:
    """(keys, range): how far the values of a key's cells stand off their base at most, but for the farthest 2 %.

    Every third cell counts, by rows of the key's whole rectangle from its lowest corner; a cell with a negative or
    missing value or base doesn't. A key has at least 0.1, also if none of its cells counts.
    """
    box = cells.groupBy(*keys).agg(F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.min("j").alias("_j0"))
    place = (F.col("j") - F.col("_j0")) * (F.col("_i1") - F.col("_i0") + 1) + F.col("i") - F.col("_i0")
    asked = cells.join(box, keys).where((place % every == 0) & (F.col(value) >= 0) & (F.col(base) >= 0))
    found = robust.order_statistics(asked, keys, F.abs(F.col(base) - F.col(value)), {"range": robust.share_of(share)})
    return box.select(*keys).join(found, keys, "left").withColumn("range", F.greatest(F.lit(least), F.col("range")))
