"""The survey, lake, canal and screening plans on surveys made of all events: one for each user, an event a frame."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import grid, sample
from fathom.plans import canal, cracks, export, lake, survey
from fathom.queries import events, query, r6, table

_N = "with e as (select event_id, user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events)"
_F = (
    _N
    + """, f as (select user_id, event_id, event_type, n, n * 0.7::double as t, 10 + n * 0.000013::double as lon, 50 + (event_id % 13) * 0.000011::double as lat, value / 40 + 0.1 as d,
  case event_type when 'signup' then 5 else 0 end as channel, event_id % 40 as held from e)"""
)


def _numbered(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "t").withColumn("n", F.row_number().over(w) - 1)


def _frames(spark, sf_dir):
    """(survey, offset, index, time_ms, lon, lat, depth_m, channel, max_range_ft, ping_size, event_type)."""
    e = _numbered(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias("survey"), F.col("event_id").alias("offset"), F.col("n").alias("index"), (F.col("n") * 700).cast("long").alias("time_ms"),
        (10 + F.col("n") * 0.000013).alias("lon"), (50 + F.col("event_id") % 13 * 0.000011).alias("lat"), (F.col("value") / 40 + 0.1).alias("depth_m"),
        F.when(F.col("event_type") == "signup", 5).otherwise(0).alias("channel"), F.lit(60.0).alias("max_range_ft"), (F.col("event_id") % 40).alias("ping_size"), "event_type",
    )


def _track(frames):
    """(track, sync): fixes up to a dozen metres beside the frames, on a clock that runs ahead by days of the week; two in three surveys trust it."""
    ahead = F.col("survey").cast("long") % 7
    fixes = frames.where("event_type in ('view', 'click', 'error')").select(
        "survey", (F.col("index") * 0.7 + ahead + 0.2).alias("t"), (F.col("lon") + F.col("offset") % 5 * 0.00004).alias("lon"), "lat", F.lit(0).alias("log_ordinal"), F.col("offset").alias("byte_offset")
    )
    sync = frames.select("survey").distinct().select("survey", (F.col("survey").cast("long") % 3 != 0).alias("trusted"), ahead.cast("double").alias("offset_s"))
    return fixes, sync


_PLACED = (
    _F
    + """, p as (select * from f where channel = 0 and d > 0.2 and d < 200)
, m as (select *, quantile_cont(d, 0.5) over (partition by user_id order by t, event_id rows between 7 preceding and 7 following) as med from p)
, a as (select * from m where abs(d - med) <= greatest(0.5, 0.25 * med)), o as (select user_id, median(lon) as lon0, median(lat) as lat0 from a group by 1)
, g as (select user_id, n * 0.7::double + user_id % 7 + 0.2::double as t, lon + (event_id % 5) * 0.00004::double as lon, lat from f where event_type in ('view', 'click', 'error'))
, q as (select *, t + user_id % 7 as tt from a)
, j as (select q.*, u.t as t0, u.lon as lon1, u.lat as lat1, v.t as t1, v.lon as lon2, v.lat as lat2 from q asof left join g u on q.user_id = u.user_id and q.tt > u.t asof left join g v on q.user_id = v.user_id and q.tt <= v.t)
, b as (select *, case when user_id % 3 <> 0 and t1 - t0 <= 2 then lon1 + (lon2 - lon1) * (tt - t0) / (t1 - t0) end as blon, case when user_id % 3 <> 0 and t1 - t0 <= 2 then lat1 + (lat2 - lat1) * (tt - t0) / (t1 - t0) end as blat from j)
, r as (select *, coalesce(sqrt(power((lon - blon) * 111320 * cos(radians(lat)), 2) + power((lat - blat) * 111320, 2)) <= 8, false) as hit from b)
, s as (select user_id, event_id, t, (case when hit then blon else lon end - lon0) * 111320 * cos(radians(lat0)) as x, (case when hit then blat else lat end - lat0) * 111320 as y, d + 0.2 as depth, hit from r join o using (user_id))"""
)


@query(_PLACED + " select user_id, round(t, 3) as t, round(x, 4) as x, round(y, 4) as y, round(depth, 6) as depth, case when hit then 'ardupilot_bin' else 'sl3_embedded' end as gps_source from s")
def lake_soundings(spark, sf_dir):
    """Plausible depths near their rolling median, at positions of two sources on one plane."""
    f = _frames(spark, sf_dir)
    got = lake.soundings(f, *_track(f))
    return got.select(F.col("survey").cast("long").alias("user_id"), F.round("t", 3).alias("t"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6("depth").alias("depth"), "gps_source")


_LAKE = (
    _PLACED
    + """, w as (select user_id, min(x) as ax, max(x) as bx, min(y) as ay, max(y) as "by" from s group by 1)
, z as (select *, greatest(1, sqrt((bx - ax + 4) * ("by" - ay + 4) / 399)) * power(1.01, k) as c from w, range(401) t(k))
, c as (select user_id, min(c) as c from z where (ceil((bx - floor(ax / c) * c + c) / c) + 2) * (ceil(("by" - floor(ay / c) * c + c) / c) + 2) <= 400 group by 1)
, k as (select user_id, c, cast(floor(x / c + 0.5) as bigint) as i, cast(floor(y / c + 0.5) as bigint) as j, median(depth) as depth, count(*) as n, quantile_cont(depth, 0.9) - quantile_cont(depth, 0.1) as spread from s join c using (user_id) group by all)
, around as (select a.i as di, b.i as dj, sqrt(a.i * a.i + b.i * b.i) as d from range(-2, 3) a(i), range(-2, 3) b(i) where a.i <> 0 or b.i <> 0)
, near as (select user_id, c, i - di as i, j - dj as j, depth, d, atan2(dj, di) as a from k join around on d <= 2 / c), open as (select near.* from near anti join k on near.user_id = k.user_id and near.i = k.i and near.j = k.j)
, turn as (select *, coalesce(lead(a) over (partition by user_id, i, j order by a, d), min(a) over (partition by user_id, i, j) + 2 * pi()) - a as gap from open)
, filled as (select user_id, c, i, j, sum(depth / (d * d)) / sum(1 / (d * d)) as depth from turn group by all having count(*) >= 3 and max(gap) < pi() - 0.01)
, model as (select user_id, c, i, j, depth, n, spread, 1 as source from k union all select user_id, c, i, j, depth, 0, null, 8 from filled)"""
)


def _lake(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return lake.lake_model(f, *_track(f), most_cells=400)


@query(_LAKE + " select user_id, round(c, 6) as cell_m, i, j, round(depth, 8) as depth, n, source from model")
def lake_cells(spark, sf_dir):
    """Every survey's lake model: its own cell size, median depths, and the cells between them."""
    got = _lake(spark, sf_dir).cells
    return got.select(F.col("survey").cast("long").alias("user_id"), r6("cell_m").alias("cell_m"), "i", "j", F.round("depth", 8).alias("depth"), "n", "source")


@query(
    _LAKE
    + """ select user_id, count(*) filter (source = 1) as measured_cells, count(*) filter (source = 8) as estimated_cells, (max(i) - min(i) + 3) * (max(j) - min(j) + 3) - count(*) as unknown_cells,
  round(count(*) filter (source = 1) * c * c, 4) as sampled_area_m2, round(quantile_cont(spread, 0.9), 8) as depth_spread_p90, round(min(depth), 8) as min_depth, round(max(depth), 8) as max_depth from model group by user_id, c"""
)
def lake_coverage(spark, sf_dir):
    """Cells and areas of every lake model, the spread of its depths, and their extent."""
    got = _lake(spark, sf_dir).coverage()
    digits = {"sampled_area_m2": 4, "depth_spread_p90": 8, "min_depth": 8, "max_depth": 8}
    return got.select(F.col("survey").cast("long").alias("user_id"), "measured_cells", "estimated_cells", "unknown_cells", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    _N
    + """, p as (select user_id, event_id, n * 0.5::double as t, n * 500 as k, n * 0.7::double + (event_id % 4) * 0.2::double as x, case when event_id % 17 = 0 then 3.0 else (event_id % 11) * 0.03::double end as y,
  cos((event_id % 9 - 4) * 0.2::double) as hx, sin((event_id % 9 - 4) * 0.2::double) as hy from e)
, a as (select *, quantile_cont(x, 0.5) over w as mx, quantile_cont(y, 0.5) over w as my, count(*) over (partition by user_id) as c from p window w as (partition by user_id order by k range between 3000 preceding and 3000 following))
, b as (select *, last_value(mx) over w - first_value(mx) over w as tx, last_value(my) over w - first_value(my) over w as ty from a window w as (partition by user_id order by k range between 1500 preceding and 1500 following))
, c as (select * from b where c < 10 or (power(x - mx, 2) + power(y - my, 2) <= 2.25 and (sqrt(tx * tx + ty * ty) < 0.3 or tx * hx + ty * hy > sqrt(tx * tx + ty * ty) * cos(radians(30)))))
, d as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as step, t - lag(t) over w as dt from c window w as (partition by user_id order by t))
, r as (select *, sum(case when step >= 1.5 or dt >= 2 then 1 else 0 end) over (partition by user_id order by t) as run from d)
, l as (select *, sum(case when step < 1.5 and dt < 2 then step end) over (partition by user_id, run) as length from r)
, s as (select *, sum(hx) over w as sx, sum(hy) over w as sy from l where length >= 3 window w as (partition by user_id, run order by k range between 1000 preceding and 1000 following))
, u as (select user_id, event_id, t, x, y, case when sx <> 0 or sy <> 0 then sx / sqrt(sx * sx + sy * sy) else hx end as hx, case when sx <> 0 or sy <> 0 then sy / sqrt(sx * sx + sy * sy) else hy end as hy from s)
, v as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy, t - lag(t) over w as gap from u window w as (partition by user_id order by t))
select event_id, round(hx, 6) as hx, round(hy, 6) as hy, round(sum(coalesce(case when gap > 2 then sqrt(dx * dx + dy * dy) else greatest(dx * hx + dy * hy, 0) end, 0)) over (partition by user_id order by t), 6) as along from v"""
)
def steady_track(spark, sf_dir):
    """Pings near their median track and along it, in long runs, with smoothed headings and way."""
    e = _numbered(spark, sf_dir)
    turn = (F.col("event_id") % 9 - 4) * 0.2
    pings = e.select(
        F.col("user_id").cast("string").alias("survey"), F.col("event_id").alias("ping"), (F.col("n") * 0.5).alias("t"), (F.col("n") * 0.7 + F.col("event_id") % 4 * 0.2).alias("x"),
        F.when(F.col("event_id") % 17 == 0, 3.0).otherwise(F.col("event_id") % 11 * 0.03).alias("y"), F.cos(turn).alias("hx"), F.sin(turn).alias("hy"),
    )
    return survey.steady_track(pings).select(F.col("ping").alias("event_id"), r6("hx").alias("hx"), r6("hy").alias("hy"), r6("along").alias("along"))


@query(_F + ", g as (select *, t - min(t) over (partition by user_id) as since from f) select event_id from g where channel = 0 and held > 0 and since >= 5 and since < 25")
def window_of_frames(spark, sf_dir):
    """Frames with samples of two channels, from 5 to 25 seconds after each survey's first ping; the end is open."""
    return export.select_window(_frames(spark, sf_dir), [0, 2], 5.0, 20.0).select(F.col("offset").alias("event_id"))


@query(
    _F
    + """ select user_id, round(max(t) - min(t), 3) as duration, count(*) filter (channel = 0) as "primary", count(*) filter (channel = 5) as sidescan, round(quantile_cont(d, 0.5) filter (channel = 0 and d > 0 and d < 20), 6) as median_depth,
  round(quantile_cont(18.288::double, 0.5) filter (channel = 5), 6) as sidescan_range_m, round(coalesce(count(*) filter (channel = 0 and d > 0.2 and d < 200) / nullif(count(*) filter (channel = 0), 0), 0), 6) as depth_coverage,
  least(count(*) filter (channel = 0), 180) as route_points, round(greatest(0, least(max(t) - min(t) - 90, (max(t) - min(t)) / 2 - 45)), 3) as preview_start from f group by 1"""
)
def survey_summary(spark, sf_dir):
    """Every survey's duration, counts, medians and depth coverage."""
    got = export.recording_summary(_frames(spark, sf_dir))
    return got.select(
        F.col("survey").cast("long").alias("user_id"), F.round("duration", 3).alias("duration"), "primary", "sidescan", r6("median_depth").alias("median_depth"), r6("sidescan_range_m").alias("sidescan_range_m"),
        r6("depth_coverage").alias("depth_coverage"), F.coalesce(F.size("route"), F.lit(0)).cast("long").alias("route_points"), F.round("preview_start", 3).alias("preview_start"),
    )


@query("with r as (select event_id, row_number() over w - 1 as i, count(*) over (partition by event_type) as n from events window w as (partition by event_type order by ts, event_id)) select event_id from r where i % cast(ceil(n / 300) as bigint) = 0")
def ping_budget(spark, sf_dir):
    """Every so-many-th event of its type, by the step that keeps each type to 300."""
    return sample.within_budget(events(spark, sf_dir).select("event_id", "event_type", "t"), ["event_type"], ["t", "event_id"], 300).select("event_id")


@query(
    """with s as (select l_suppkey as supplier, l_linenumber % 2 as side, l_discount > 0.05 as open, l_quantity as waterline, l_quantity * 0.6::double as toe, l_extendedprice / 9973 as height, l_tax > 0.03 as assumed from lineitem)
select supplier, side, round(median(waterline), 6) as waterline, round(median(toe), 6) as toe, round(median(height / nullif(waterline - toe, 0)) filter (not open), 9) as slope, avg(assumed::int) filter (not open) >= 0.5 as assumed
from s group by all having avg((not open)::int) >= 0.5"""
)
def bank_summary(spark, sf_dir):
    """Medians of every supplier's two sides, where at least half of a side is closed."""
    q = F.col("l_quantity").cast("double")
    sides = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("survey"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_discount") > 0.05).alias("open"), q.alias("waterline"), (q * 0.6).alias("toe"), (F.col("l_extendedprice") / 9973).alias("height"), (F.col("l_tax") > 0.03).alias("assumed")
    )
    return canal.bank_summary(sides).select(F.col("survey").alias("supplier"), "side", r6("waterline").alias("waterline"), r6("toe").alias("toe"), F.round("slope", 9).alias("slope"), "assumed")


@query(
    """with o as (select event_id, user_id, value / 7 as x, (event_id % 50) * 0.37::double as y, 0.7 + event_id % 3 as hl, 0.45 + (event_id % 2) * 0.3::double as hw, (event_id % 6) * 0.5::double as turn, 0.1 + (event_id % 5) * 0.05::double as high from events where event_type = 'purchase')
, g as (select o.*, a.k + cast(floor(x / 0.5 + 0.5) as bigint) as i, b.k + cast(floor(y / 0.5 + 0.5) as bigint) as j from o, range(-6, 7) a(k), range(-6, 7) b(k) where greatest(abs(a.k), abs(b.k)) <= ceil(greatest(hl, hw) / 0.5))
, r as (select *, sqrt(power(((i * 0.5 - x) * cos(turn) + (j * 0.5 - y) * sin(turn)) / hl, 2) + power(((j * 0.5 - y) * cos(turn) - (i * 0.5 - x) * sin(turn)) / hw, 2)) as r from g)
select user_id, i, j, round(sum(high * case when r <= 0.8 then 1 else (1 - r) / 0.2 end), 6) as raised, max(event_id) as id from r where r < 1 group by all"""
)
def stamped_objects(spark, sf_dir):
    """Every purchase stamped as an ellipse with tapering edge into its user's grid."""
    e = events(spark, sf_dir, "purchase")
    n = F.col("event_id")
    objects = e.select(
        "user_id", n.alias("id"), (F.col("value") / 7).alias("x"), (n % 50 * 0.37).alias("y"), (0.7 + n % 3).alias("half_length"), (0.45 + n % 2 * 0.3).alias("half_width"), (n % 6 * 0.5).alias("heading"), (0.1 + n % 5 * 0.05).alias("height")
    )
    return grid.stamp(objects, 0.5, ["user_id"]).select("user_id", "i", "j", r6("raised").alias("raised"), "id")


_VECTORS = "with v as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings), c as (select cast(floor(x / 0.05 + 0.5) as bigint) as i, cast(floor(y / 0.05 + 0.5) as bigint) as j, median(z) as m from v group by all)"


@query(_VECTORS + " select vec_id, round(m, 6) as sampled from v left join c on i = cast(floor((y + 0.01) / 0.05 + 0.5) as bigint) and j = cast(floor((x - 0.01) / 0.05 + 0.5) as bigint)")
def nearest_cell(spark, sf_dir):
    """The value of the cell that each vector's place, mirrored and moved, rounds to; null outside."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    probes = v.select("vec_id", (F.col("y") + 0.01).alias("px"), (F.col("x") - 0.01).alias("py"))
    return grid.nearest_cell(probes, grid.median_cells(v, "x", "y", "z", 0.05), "px", "py", 0.05, "value", "sampled").select("vec_id", r6("sampled").alias("sampled"))


@query(
    """with c as (select l_suppkey as supplier, l_partkey % 23 as i, cast(l_quantity as bigint) % 19 as j, avg(l_extendedprice) / 10000 as depth, max(l_extendedprice) / 10000 - 1 as base from lineitem group by all)
, b as (select supplier, min(i) as i0, max(i) as i1, min(j) as j0 from c group by 1)
, v as (select supplier, abs(base - depth) as v, row_number() over (partition by supplier order by abs(base - depth)) - 1 as k, count(*) over (partition by supplier) as n from c join b using (supplier) where ((j - j0) * (i1 - i0 + 1) + i - i0) % 3 = 0 and depth >= 0 and base >= 0)
select supplier, round(greatest(0.1, max(v) filter (k = least(n - 1, cast(floor(n * 0.98::double) as bigint)))), 9) as range from b left join v using (supplier) group by 1"""
)
def relief_range(spark, sf_dir):
    """How far each supplier's mean prices stand off their dearest, by every third cell of parts and quantities."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 23).alias("i"), (F.col("l_quantity").cast("long") % 19).alias("j")).agg(
        (F.avg("l_extendedprice") / 10000).alias("depth"), (F.max("l_extendedprice") / 10000 - 1).alias("base")
    )
    return grid.relief_range(cells, ["supplier"], "depth", "base").select("supplier", F.round("range", 9).alias("range"))


@query(
    _N
    + """, p as (select user_id, event_id, n * 1.7::double as along, n * 1.3::double as x, value / 50 as y, cos(n) as hx, sin(n) as hy from e where event_type not in ('purchase', 'error')), c as (select user_id, event_id, value / 60 as x1, n * 1.7::double + 0.3 as y1, -value / 90 as x2, n * 1.9::double - 4 as y2 from e where event_type = 'purchase')
, u as (select user_id, event_id, 1 as k, x1 as o, y1 as way from c union all select user_id, event_id, 2, x2, y2 from c)
, b as (select u.user_id, u.event_id, k, o, arg_min({'x': p.x, 'y': p.y, 'hx': p.hx, 'hy': p.hy}, (abs(p.along - way), p.along)) as p from u left join p on p.user_id = u.user_id group by u.user_id, u.event_id, k, o)
, s as (select user_id, event_id, k, 10 + (p.x - o * p.hy) / (111320 * cos(radians(50.0))) as lon, 50 + (p.y + o * p.hx) / 111320 as lat from b)
select user_id, event_id, round(max(lon) filter (k = 1), 9) as lon1, round(max(lat) filter (k = 1), 9) as lat1, round(max(lon) filter (k = 2), 9) as lon2, round(max(lat) filter (k = 2), 9) as lat2 from s group by all"""
)
def placed_candidates(spark, sf_dir):
    """The two ends of each purchase on its user's map, by the event nearest along the way, however far."""
    e = _numbered(spark, sf_dir).withColumn("survey", F.col("user_id"))
    n = F.col("n")
    pings = e.where("event_type not in ('purchase', 'error')").select("survey", F.col("event_id").alias("ping"), (n * 1.7).alias("along"), (n * 1.3).alias("x"), (F.col("value") / 50).alias("y"), F.cos(n).alias("hx"), F.sin(n).alias("hy"), F.lit(10.0).alias("lon0"), F.lit(50.0).alias("lat0"))
    found = e.where("event_type = 'purchase'").select("survey", F.col("event_id").alias("id"), (F.col("value") / 60).alias("x1"), (n * 1.7 + 0.3).alias("y1"), (-F.col("value") / 90).alias("x2"), (n * 1.9 - 4).alias("y2"))
    ends = F.col("lonlat")
    return cracks.placed(found, pings).select(F.col("survey").alias("user_id"), F.col("id").alias("event_id"), *[F.round(ends[k][p], 9).alias(f"{c}{k + 1}") for k in (0, 1) for p, c in enumerate(("lon", "lat"))])


@query(
    """with c as (select event_id, case when value >= 1.8 * 40 then 'high' when value >= 1.35 * 40 then 'medium' else 'low' end as level, event_id % 90 as angle, value / 100 - 0.5 as l, 0.6 - value / 70 as r from events)
, d as (select event_id, case when level = 'high' and event_id % 4 = 0 then 'medium' else level end as confidence, case when angle <= 20 then 'along' when angle >= 70 then 'across' else 'diagonal' end as direction,
  case when least(l, r) < -0.3 and greatest(l, r) > 0.3 then 'both' when l + r < 0 then 'port' else 'starboard' end as side, case when event_id % 5 = 0 then 'open crack, 3 cm' else 'dark line' end as detail from c)
select event_id, confidence, direction, side, case when detail like 'open crack%' then 'Open crack' when direction = 'along' then 'Crack or step down' else 'Crack' end as label from d where confidence <> 'low' or event_id in (3, 7)"""
)
def shown_candidates(spark, sf_dir):
    """F10 and the classes of a line: what is on view with two lines of low confidence chosen."""
    n, v = F.col("event_id"), F.col("value")
    direction = text.direction_class(n % 90)
    detail = F.when(n % 5 == 0, "open crack, 3 cm").otherwise("dark line")
    found = events(spark, sf_dir).select(
        n.alias("id"), text.confidence_class(v, F.lit(40.0), n % 4 == 0).alias("confidence"), direction.alias("direction"), text.side_class(v / 100 - 0.5, 0.6 - v / 70).alias("side"), text.line_label(detail, direction).alias("label")
    )
    return cracks.shown(found, chosen=[3, 7]).withColumnRenamed("id", "event_id")


_NAMES = "with n as (select page_id, url || case page_id % 3 when 0 then '.SL3' when 1 then '.bin' else '' end as name, page_id * 37.6 as s, case when page_id % 4 > 0 then (page_id % 1700) / 10 - 85 end as lat, case when page_id % 4 > 0 then (page_id % 3600) / 10 - 180 end as lon from pages), t as (select *, regexp_replace(regexp_replace(name, '\\.sl3$', '', 'i'), '[^A-Za-z0-9_.-]+', '_', 'g') as stem, cast(floor(s + 0.5) as bigint) as w from n)"


@query(
    _NAMES
    + """ select page_id, case when lower(name) like '%.sl3' then 'sonar' when lower(name) like '%.bin' then 'log' end as role, stem || '_route.gpx' as route,
  stem || case page_id % 2 when 0 then '_sidescan_' else '_downscan_' end || w // 3600 || 'h' || lpad(cast(w % 3600 // 60 as varchar), 2, '0') || 'm' || lpad(cast(w % 60 as varchar), 2, '0') || 's'
  || coalesce('_' || printf('%.5f', abs(lat)) || case when lat < 0 then 'S' else 'N' end || '_' || printf('%.5f', abs(lon)) || case when lon < 0 then 'W' else 'E' end, '') || '.png' as picture from t"""
)
def file_names(spark, sf_dir):
    """K8, K9: what each page's address would be as a file, and the names of its route and of a picture at a place."""
    n = F.col("page_id")
    at = lambda most: F.when(n % 4 > 0, n % most / 10)
    ending = F.when(n % 3 == 0, ".SL3").when(n % 3 == 1, ".bin").otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("name"))
    picture = text.picture_name(F.col("name"), F.when(n % 2 == 0, 5).otherwise(2), n * 37.6, at(3600) - 180, at(1700) - 85)
    return p.select("page_id", text.file_role(F.col("name")).alias("role"), text.route_name(F.col("name"), "gpx").alias("route"), picture.alias("picture"))
