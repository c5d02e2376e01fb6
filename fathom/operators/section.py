"""One side of a ping as a cross-section: array functions on rows, with no Python workers and no shuffle.

A row has `echo` (samples from the boat outward, array<double>), `height` (of the transducer over the bed) and
`range_m`. Means over any stretch of samples come from running sums, order statistics from the sorted stretch,
edges and first places from filters of index sequences; so each reading is a projection that Catalyst can
prune, and its cost follows the samples of the side alone.

A shadow from sample a to sample b is thrown by a thing whose top is as high as height * (1 - a/b): both
slant ranges end on the ray over its top (similar triangles), so the height needs no iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.arrays import let, running, smooth, staged

# Fixed values, which decide what is found: lengths in metres, shares of levels.
REFERENCE_STEP, RELIEF_STEP = 0.05, 0.1
SMOOTH, FAINT, BED_M = 2, 0.05, 2.0
FADE_M, DARK_M, FADE_SHARE, LEAST_CONTRAST = 0.5, 3.0, 0.2, 4.0
BROAD_M, BRIDGE_M, LEAST_SHADOW_M, BESIDE_M = 0.07, 0.1, 0.15, 0.5
SHADE_LEVEL, SHADE_RATIO, NEAREST_M, BRIGHTER, HIGHEST = (0.18, 0.3), (0.55, 0.2), 0.3, 1.15, 0.9
LIT_BED_M, LIT_REACH_M, LEAST_LIT_M, NO_LIT_M = (1.5, 0.6), 2.0, 0.2, 0.3
TOE_STEP_M, TOE_MARGIN_M, LEAST_GAIN, BANK_SLOPE = 0.1, 0.4, 0.2, 1.5
FEATURE = "array<struct<kind:string,start:double,end:double,lit:double,height:double,shadow_start:double,shadow_end:double,contrast:double>>"
SPAN = "array<struct<a:int,b:int>>"


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i.cast("int"))


def _part(values: Column, a: Column, b: Column) -> Column:
    """The samples a to b, end exclusive."""
    return F.slice(values, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))


def _indices(a: Column, b: Column, step: Column | None = None) -> Column:
    """a to b, end exclusive; empty where there are none."""
    none = F.expr("cast(array() as array<int>)")
    last = (b - 1).cast("int")
    return F.when(b > a, F.sequence(a.cast("int"), last, step.cast("int")) if step is not None else F.sequence(a.cast("int"), last)).otherwise(none)


def level(values: Column, q: float) -> Column:
    """The order statistic floor(q*n) of the rounded values within 0 and 255; null of none."""
    rounded = F.transform(values, lambda x: F.least(F.greatest(F.floor(x + 0.5).cast("double"), F.lit(0.0)), F.lit(255.0)))
    return let(F.array_sort(rounded), lambda s: F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * q).cast("int"))))


def between(a: Column, b: Column) -> Column:
    """The mean of the samples a to b, end exclusive, from the running sums; 0 of none."""
    a, b = (F.least(F.greatest(x, F.lit(0)), F.col("n")).cast("int") for x in (a, b))
    total = F.coalesce(F.get("sums", b - 1), F.lit(0.0)) - F.coalesce(F.get("sums", a - 1), F.lit(0.0))
    return F.when(b > a, total / (b - a)).otherwise(0.0)


def flat(r: Column, raised: Column | float = 0.0) -> Column:
    """Ground range of a slant range to something `raised` over the bed."""
    up = F.col("height") - raised
    return F.sqrt(F.greatest(F.lit(0.0), r * r - up * up))


def _samples(metres: float) -> Column:
    return F.round(F.lit(metres) / F.col("dr")).cast("int")


def levels(sides: DataFrame) -> DataFrame:
    """sides with the smoothed samples s, their running sums, n, dr, first (sample of the bed), noise and bed levels."""
    n, first, s = F.col("n"), F.col("first"), F.col("s")
    out = staged(sides, s=smooth(F.col("echo"), SMOOTH), n=F.size("echo"), dr=F.col("range_m") / F.greatest(F.size("echo"), F.lit(1)))
    out = staged(out, first=F.least(n - 1, F.greatest(F.lit(0), F.floor(F.col("height") / F.col("dr")).cast("int"))), sums=running(s, lambda a, b: a + b))
    faint = level(s, FAINT)
    near = F.least(n, F.floor(F.hypot(F.lit(BED_M), F.col("height")) / F.col("dr")).cast("int"))
    noise = F.when(first > 6, F.least(level(_part(s, F.lit(1), first - 1), 0.5), faint)).otherwise(faint)
    bed = F.when(near > first + 8, level(_part(s, first + 2, near), 0.5)).otherwise(level(_part(s, first, n), 0.6))
    return staged(out, noise=noise, bed=bed)


def outline(sides: DataFrame, draft: float) -> DataFrame:
    """levels() with empty, end (the first sample beyond the water's edge), open, reach, waterline and row: the mean echo
    of every REFERENCE_STEP of slant range plus one, 0 where unknown."""
    n, first, dr = F.col("n"), F.col("first"), F.col("dr")
    window = F.greatest(F.lit(3), _samples(FADE_M))
    limit = F.col("noise") + FADE_SHARE * (F.col("bed") - F.col("noise"))
    places = _indices(first + window, n - window, F.greatest(F.lit(1), F.floor(window / 8).cast("int")))
    faded = F.filter(places, lambda i: (between(i, i + window) < limit) & (between(i, i + _samples(DARK_M)) < limit) & (between(i, n) < limit))
    out = staged(levels(sides), empty=~F.coalesce(F.col("bed") > F.col("noise") + LEAST_CONTRAST, F.lit(False)))
    out = staged(out, end=F.when(F.col("empty"), n).otherwise(F.coalesce(F.get(faded, F.lit(0)), n)))
    shut = ~F.col("empty") & (F.col("end") < n - window)
    out = staged(out, open=~shut, reach=flat(F.col("range_m")))
    edge = F.col("end") * dr
    out = staged(out, waterline=F.when(shut, F.sqrt(F.greatest(F.lit(0.0), edge * edge - draft * draft))))
    cells = F.ceil(F.col("range_m") / REFERENCE_STEP).cast("int")

    def cell(c: Column) -> Column:
        starts = [F.ceil(k * REFERENCE_STEP / dr - 1e-9).cast("int") for k in (c, c + 1)]
        a, b = F.greatest(starts[0], first), F.when(c == cells - 1, F.col("end")).otherwise(F.least(starts[1], F.col("end")))
        return F.when((b > a) & ~F.col("empty"), F.least(F.lit(255), F.floor(between(a, b) + 0.5).cast("int") + 1)).otherwise(F.lit(0))

    return staged(out, row=F.transform(_indices(F.lit(0), cells), cell))


def _spans(dark: Column, bridge: Column) -> Column:
    """(a, b) of the runs of true; runs less than `bridge` apart are one."""

    def joined(both: Column) -> Column:
        a, b = both["a"], both["b"]
        starts = F.filter(a, lambda x, k: (k == 0) | (x - F.get(b, k - 1) >= bridge))
        ends = F.filter(b, lambda x, k: (k == F.size(b) - 1) | (F.get(a, k + 1) - x >= bridge))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))

    def edges(mask: Column) -> Column:
        every = _indices(F.lit(0), F.size(mask))
        first = F.filter(every, lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i - 1), F.lit(False)))
        last = F.filter(every, lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i + 1), F.lit(False)))
        return F.struct(first.alias("a"), F.transform(last, lambda i: i + 1).alias("b"))

    return let(let(dark, edges), joined)


def shadows(outlined: DataFrame, sensitivity: float) -> DataFrame:
    """outlined (see outline) and its column `reference`, the usual echo by range, with usual, shadows and features."""
    n, first, end, dr, s = F.col("n"), F.col("first"), F.col("end"), F.col("dr"), F.col("s")
    ratio = SHADE_RATIO[0] + SHADE_RATIO[1] * sensitivity
    out = staged(outlined, usual=F.coalesce(F.nullif(level(_part(s, first, end), 0.6), F.lit(0.0)), F.col("bed")))
    known = F.size("reference")

    def around(i: Column) -> Column:
        v = F.get("reference", F.least(F.floor(i * dr / REFERENCE_STEP).cast("int"), known - 1))
        return F.when(v > 0, v).otherwise(F.col("usual"))

    half = F.when(dr < 0.03, _samples(BROAD_M)).otherwise(F.lit(0))
    least_level = F.col("noise") + (SHADE_LEVEL[0] + SHADE_LEVEL[1] * sensitivity) * (F.col("usual") - F.col("noise"))
    out = staged(out, broad=F.transform(s, lambda _, i: between(i - half, F.least(i + half + 1, n))))
    dark = F.transform("broad", lambda x, i: (i >= first + 3) & (i < end - 3) & (x < F.greatest(least_level, ratio * around(i))))
    wide = F.greatest(F.lit(3), _samples(LEAST_SHADOW_M))
    out = staged(out, found=F.filter(_spans(dark, _samples(BRIDGE_M)), lambda x: (x["b"] - x["a"] >= wide) & (x["b"] < end - 3)))
    beside = F.greatest(F.lit(3), _samples(BESIDE_M))

    def measured(x: Column) -> Column:
        a, b = x["a"], x["b"]
        before, after = between(F.greatest(first, a - beside), F.least(end, a)), between(F.greatest(first, b), F.least(end, b + beside))
        return F.struct(a.alias("a"), b.alias("b"), before.alias("before"), after.alias("after"), between(a, b).alias("inside"), around(F.floor((a + b) / 2)).alias("bed"))

    def edged(x: Column) -> Column:
        """With a and b moved out to where the echo is half-way back to what it is beside the shadow."""
        low, high = (x["inside"] + x["before"]) / 2, (x["inside"] + x["after"]) / 2
        back = F.array_max(F.filter(_indices(first + 1, x["a"]), lambda i: _at(s, i) >= low)) + 1
        on = F.get(F.filter(_indices(x["b"], end - 1), lambda i: _at(s, i) >= high), F.lit(0))
        a, b = F.when(x["a"] > first + 1, F.coalesce(back, first + 1)).otherwise(x["a"]), F.when(x["b"] < end - 1, F.coalesce(on, end - 1)).otherwise(x["b"])
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), *[x[c].alias(c) for c in ("before", "after", "inside", "bed")])

    out = staged(out, found=F.transform(F.transform("found", measured), edged))
    fit = lambda x: (flat(x["b"] * dr) > flat(x["a"] * dr)) & (flat(x["a"] * dr) > NEAREST_M) & (x["inside"] < (ratio + 0.05) * x["bed"])
    out = staged(out, found=F.filter("found", fit))
    out = staged(out, shadows=F.transform("found", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))

    def feature(x: Column) -> Column:
        a, b = x["a"], x["b"]
        near, far = flat(a * dr), flat(b * dr)
        contrast = F.greatest(F.lit(0.0), 1 - x["inside"] / x["bed"])
        sunk = x["after"] >= BRIGHTER * F.greatest(x["before"], x["bed"])
        high = F.least(HIGHEST * F.col("height"), F.greatest(F.lit(0.0), F.col("height") * (1 - a / b)))
        top = flat(a * dr, high)
        front = _part(s, F.greatest(first + 2, a - _samples(LIT_BED_M[0])), F.greatest(F.lit(0), a - _samples(LIT_BED_M[1])))
        bed = F.when(F.size(front) >= 8, level(front, 0.5)).otherwise(F.col("usual"))
        reach = F.greatest(first + 2, a - _samples(LIT_REACH_M))
        dull = F.coalesce(F.array_max(F.filter(_indices(reach, a), lambda i: _at(s, i) <= BRIGHTER * bed)) + 1, F.least(reach, a))
        lit = F.when(a - dull > 2, F.greatest(F.lit(LEAST_LIT_M), top - flat(dull * dr, high)))
        names = ("kind", "start", "end", "lit", "height", "shadow_start", "shadow_end", "contrast")
        hole = (F.lit("depression"), near, far, far - near, F.col("height") * (far - near) / near, near, far, contrast)
        thing = (F.lit("object"), top - F.coalesce(lit, F.lit(NO_LIT_M)), top, lit, high, top, far, contrast)
        return F.when(sunk, F.struct(*[v.alias(k) for k, v in zip(names, hole)])).otherwise(F.struct(*[v.alias(k) for k, v in zip(names, thing)]))

    nothing = lambda kind: F.expr(f"cast(array() as {kind})")
    out = staged(out, features=F.when(F.col("empty"), nothing(FEATURE)).otherwise(F.transform("found", feature)))
    return staged(out, shadows=F.when(F.col("empty"), nothing(SPAN)).otherwise(F.col("shadows"))).drop("found", "broad")


def two_lines(points: Column, margin: float) -> Column:
    """struct(place, gain) of the best split of points (array of x, y by x) into two straight lines, `margin` from both ends;
    gain is the share of the squared error that it saves. Null of fewer than 8 points."""
    terms = ("n", "x", "y", "xx", "xy", "yy")
    one = lambda p: F.struct(F.lit(1.0).alias("n"), p["x"].alias("x"), p["y"].alias("y"), (p["x"] * p["x"]).alias("xx"), (p["x"] * p["y"]).alias("xy"), (p["y"] * p["y"]).alias("yy"))
    plus = lambda a, b, sign=1: F.struct(*[(a[t] + sign * b[t]).alias(t) for t in terms])

    def error(t: Column) -> Column:
        vx, c, vy = t["xx"] - t["x"] * t["x"] / t["n"], t["xy"] - t["x"] * t["y"] / t["n"], t["yy"] - t["y"] * t["y"] / t["n"]
        return F.greatest(F.lit(0.0), vy - F.when(vx > 1e-12, c * c / vx).otherwise(0.0))

    def best(both: Column) -> Column:
        p, sums = both["p"], both["sums"]
        n, whole = F.size(p), F.get(both["sums"], F.size(both["sums"]) - 1)
        inner = F.filter(_indices(F.lit(2), n - 3), lambda i: (F.get(p, i)["x"] - F.get(p, F.lit(0))["x"] >= margin) & (F.get(p, n - 1)["x"] - F.get(p, i)["x"] >= margin))
        each = F.transform(inner, lambda i: F.struct((error(F.get(sums, i)) + error(plus(whole, F.get(sums, i), -1))).alias("error"), i.alias("i")))
        place = lambda m: (F.get(p, m["i"])["x"] + F.get(p, m["i"] + 1)["x"]) / 2
        return F.when((n >= 8) & (error(whole) > 0), let(F.array_min(each), lambda m: F.when(m.isNotNull(), F.struct(place(m).alias("place"), (1 - m["error"] / error(whole)).alias("gain")))))

    return let(points, lambda p: let(F.struct(p.alias("p"), running(F.transform(p, one), plus).alias("sums")), best))


def toe(shaded: DataFrame, draft: float) -> DataFrame:
    """shaded (see shadows) with toe, where the bed meets a bank: the break of the echoes over ground range, or assumed from
    the depth; features and shadows beyond it go."""
    first, end, dr, height = (F.col(c) for c in ("first", "end", "dr", "height"))
    banked = ~F.col("open") & (F.col("waterline") > 1)
    start = F.greatest(F.lit(1.0), height) + TOE_STEP_M / 2
    count = F.greatest(F.lit(0), F.ceil((F.col("waterline") - start) / TOE_STEP_M)).cast("int")
    bins = F.transform(_indices(F.lit(0), count), lambda k: F.struct((start + k * TOE_STEP_M).alias("x"), F.floor(F.hypot(start + k * TOE_STEP_M, height) / dr).cast("int").alias("i")))
    clear = lambda i: ~F.exists("shadows", lambda w: (i >= w["a"] - 3) & (i < w["b"] + 3))
    seen = F.filter(bins, lambda p: (p["i"] >= first) & (p["i"] < end) & clear(p["i"]))
    points = F.transform(seen, lambda p: F.struct(p["x"].alias("x"), _at(F.col("s"), p["i"]).alias("y")))
    out = staged(shaded, split=F.when(banked & ~F.col("empty"), two_lines(points, TOE_MARGIN_M)))
    sure = F.coalesce((F.col("split.gain") >= LEAST_GAIN) & (F.col("split.place") < F.col("waterline") - 0.2), F.lit(False))
    guess = F.greatest(F.lit(0.3), F.col("waterline") - BANK_SLOPE * (height + draft))
    out = staged(out, toe=F.when(banked & ~F.col("empty"), F.when(sure, F.col("split.place")).otherwise(guess)))
    out = staged(out, assumed=F.col("toe").isNotNull() & ~sure).drop("split")
    edge = F.hypot("toe", height) / dr
    kept = F.when(F.col("toe").isNull(), F.col("features")).otherwise(F.filter("features", lambda f: f["start"] < F.col("toe")))
    return staged(out, features=kept, shadows=F.when(F.col("toe").isNull(), F.col("shadows")).otherwise(F.filter("shadows", lambda w: w["a"] < edge)))


def relief(shaded: DataFrame, stop: Column) -> DataFrame:
    """shaded with relief: heights of the bed every RELIEF_STEP metres up to the sample `stop`, from how its echo differs from the
    reference, level at both ends and 0 where things lie; null where under 20 places can be read."""
    first, end, dr, height, s = (F.col(c) for c in ("first", "end", "dr", "height", "s"))
    count = F.floor(F.sqrt(F.greatest(F.lit(0.0), F.pow(stop * dr, 2) - height * height)) / RELIEF_STEP).cast("int")

    def place(k: Column) -> Column:
        y = (k + 0.5) * RELIEF_STEP
        r = F.hypot(y, height)
        i = F.least(F.floor(r / dr).cast("int"), F.col("n") - 1)
        ref = F.get("reference", F.least(F.floor(r / REFERENCE_STEP).cast("int"), F.size("reference") - 1))
        clear = ~F.exists("shadows", lambda w: (i >= w["a"] - 6) & (i < w["b"] + 6))
        ok = (i >= first + 3) & (i < end) & clear & (ref > 1) & (y >= 0.5)
        angle = F.atan2(y, height)
        shade = F.least(F.greatest(F.pow(_at(s, i) / ref, 1 / 1.2) * F.cos(angle), F.lit(0.0)), F.lit(1.0))
        slope = F.tan(F.least(F.greatest(angle - F.acos(shade), F.lit(-0.6)), F.lit(0.6)))
        return F.when(ok, slope)

    def pinned(x: Column) -> Column:
        size = F.size(x)
        edge = F.least(F.lit(5), F.floor(size / 4).cast("int"))
        mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, b: a + b) / edge
        ends = F.struct(mean(F.slice(x, F.lit(1), edge)).alias("a"), mean(F.slice(x, size - edge + 1, edge)).alias("b"))
        return let(ends, lambda e: F.transform(x, lambda v, k: v - (e["a"] + (e["b"] - e["a"]) * (k / (size - 1)))))

    out = staged(shaded, slopes=F.when(~F.col("empty") & (count >= 20) & (F.size("reference") > 0), F.transform(_indices(F.lit(0), count), place)))
    out = staged(out, slopes=F.when(F.size(F.filter("slopes", lambda x: x.isNotNull())) >= 20, F.transform("slopes", lambda x: F.coalesce(x, F.lit(0.0)))))
    steps = F.transform(smooth(F.col("slopes"), 4), lambda x, k: F.when(k == 0, 0.0).otherwise(x * RELIEF_STEP))
    out = staged(out, slopes=F.when(F.col("slopes").isNotNull(), let(running(steps, lambda a, b: a + b), pinned)))
    level_ = let(F.arrays_zip(F.col("slopes").alias("h"), smooth(F.col("slopes"), 60).alias("m")), lambda z: F.transform(z, lambda x: x["h"] - x["m"]))
    out = staged(out, slopes=F.when(F.size("slopes") * RELIEF_STEP > 12, let(level_, pinned)).otherwise(F.col("slopes")))
    hidden = lambda k: F.exists("features", lambda f: (k >= F.floor((f["start"] - 0.5) / RELIEF_STEP)) & (k < F.ceil((f["shadow_end"] + 0.3) / RELIEF_STEP)))
    return staged(out, relief=F.transform("slopes", lambda x, k: F.when(hidden(k), 0.0).otherwise(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))).drop("slopes")
