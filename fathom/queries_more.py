"""Further operators on the star-schema tables: long tracks, order-dependent groups, parts of quantiles, and recordings made of events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from fathom.operators import asof, graph, grid, groups, overlap, robust, session, track
from fathom.queries import events, query, r6, table
from fathom.sources import fixes_from_files, frames_from_files, synthetic

#: So few rows make one chunk or block here that the queries' tracks have many.
SMALL = 2000

_ALL = "with e as (select event_id, event_type, value, epoch(ts) as t from events), p as (select * from e where event_type = 'error'), f as (select * from e where event_type = 'purchase')"


@query(
    _ALL
    + """, j as (select p.*, a.t as ta, a.value as av, b.t as tb, b.value as bv from p asof left join f a on p.t > a.t asof left join f b on p.t <= b.t)
select event_id, round(case when tb - ta > 0 and tb - ta <= 3600 then av + (bv - av) * ((t - ta) / (tb - ta)) end, 6) as value_at from j"""
)
def long_asof_interpolate(spark, sf_dir):
    """J1-J3 on one long track: all purchases are one series over many tasks."""
    e = events(spark, sf_dir).select(F.lit(1).alias("track"), "event_id", "event_type", "t", "value")
    got = track.interpolate(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["track"], "t", ["value"], ["event_id"], 3600.0, rows=SMALL)
    return got.select("event_id", r6("at_value").alias("value_at"))


_WIDE = "over (order by ts, event_id rows between 7 preceding and 7 following)"


@query(f"select event_id, value from (select *, quantile_cont(value, 0.5) {_WIDE} as m from events) where abs(value - m) <= greatest(0.5, 0.25 * m)")
def long_despike(spark, sf_dir):
    """F5, W1 on one long track."""
    e = events(spark, sf_dir).select(F.lit(1).alias("track"), "event_id", "t", "value")
    return track.despike(e, ["track"], "t", ["event_id"], "value", rows=SMALL).select("event_id", "value")


@query(
    """with s as (select *, case when epoch(ts) - lag(epoch(ts)) over w >= 120 then 1 else 0 end as f from events window w as (order by ts, event_id))
select event_id, row_number() over (order by ts, event_id) - 1 as n, cast(sum(f) over (order by ts, event_id rows unbounded preceding) as bigint) as session from s"""
)
def long_sessionise(spark, sf_dir):
    """W9, W15 on one long track: row numbers, and runs of events less than two minutes apart."""
    e = events(spark, sf_dir).select(F.lit(1).alias("track"), "event_id", "t")
    runs = track.sessionise(e, ["track"], "t", ["event_id"], F.col("t") - F.col("prev.t") >= 120, rows=SMALL)
    return track.numbered(runs, ["track"], "t", ["event_id"], "n", SMALL).select("event_id", "n", F.col("session").cast("long").alias("session"))


@query(
    """select l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 4) as p02, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.98), 4) as p98,
  round(quantile_cont(l_extendedprice, 0), 4) as least, round(quantile_cont(l_extendedprice, 1), 4) as most from lineitem group by all"""
)
def quantile_parts(spark, sf_dir):
    """Exact quantiles of keys that hold a third of all rows each, found part by part."""
    got = robust.part_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p02": 0.02, "p50": 0.5, "p98": 0.98, "least": 0.0, "most": 1.0})
    return got.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p02", "p50", "p98", "least", "most")])


_CELL = """with b as (select user_id, max(value) - min(value) as w, (epoch(max(ts)) - epoch(min(ts))) / 86400 as h from events group by all)
, s as (select *, greatest(0.5, sqrt(w * h / 1000)) as first from b), k as (select *, first * power(1.01, k) as size from s, range(401) t(k))"""


@query(_CELL + " select user_id, round(min(size), 6) as size from k where (ceil(w / size) + 3) * (ceil(h / size) + 3) <= 1000 group by user_id")
def cell_sizes(spark, sf_dir):
    """For each user the smallest cell, by steps of a hundredth, that keeps their value-by-day area within 1,000 cells."""
    spans = events(spark, sf_dir).groupBy("user_id").agg((F.max("value") - F.min("value")).alias("w"), ((F.max("t") - F.min("t")) / 86400).alias("h"))
    return spans.select("user_id", r6(grid.fitting_size(F.col("w"), F.col("h"), 1000, 0.5, 1.0)).alias("size"))


@query(
    """with v as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)
select p.vec_id, arg_min(q.vec_id, (power(p.x * 30 - q.x, 2) + power(p.y * 30 - q.y, 2), q.vec_id)) as near_id, round(sqrt(min(power(p.x * 30 - q.x, 2) + power(p.y * 30 - q.y, 2))), 6) as apart
from v p join v q on p.vec_id <> q.vec_id where p.vec_id % 20 = 0 group by p.vec_id"""
)
def nearest_anywhere(spark, sf_dir):
    """The nearest vector to thirty times each place whose id is divisible by 20, most of which lie far outside all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    probes = v.where("vec_id % 20 = 0").select("vec_id", (F.col("x") * 30).alias("px"), (F.col("y") * 30).alias("py"))
    got = asof.nearest_anywhere(probes, v, ("px", "py"), ("x", "y"), "vec_id", 0.1, itself="vec_id")
    return got.select("vec_id", F.col("near.order").alias("near_id"), r6(F.sqrt("near.d2")).alias("apart"))


@query(
    """with r as (select l_suppkey, epoch(l_shipdate) / 86400 - 3 as low, epoch(l_shipdate) / 86400 + 3 as high, l_quantity - 5 as left_, l_quantity + 5 as right_ from lineitem where l_discount >= 0.09)
select l_orderkey, l_linenumber from lineitem p where not exists (select 1 from r where r.l_suppkey = p.l_suppkey and epoch(p.l_shipdate) / 86400 between low and high and p.l_quantity between left_ and right_)"""
)
def outside_rectangles(spark, sf_dir):
    """Line items that no discounted one of their supplier covers, on the two axes of date and quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", F.col("l_quantity").cast("double").alias("q"), (F.unix_timestamp("l_shipdate") / 86400).alias("day"))
    boxes = li.where("l_discount >= 0.09").select("l_suppkey", (F.col("day") - 3).alias("low"), (F.col("day") + 3).alias("high"), (F.col("q") - 5).alias("left"), (F.col("q") + 5).alias("right"))
    return graph.outside_rectangles(li, boxes, ["l_suppkey"], "day", "q", 7.0).select("l_orderkey", "l_linenumber")


_ORDERED = "with recursive e as (select event_id, user_id, event_type, value, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events)"


@query(
    _ORDERED
    + """, r as (select user_id, n, event_id, cast(1 as bigint) as g, [{'g': cast(1 as bigint), 'k': event_type, 'x': value, 't': t}] as held from e where n = 1
 union all select user_id, n, event_id, coalesce(hit, len(held) + 1), case when hit is null then list_append(held, {'g': cast(len(held) + 1 as bigint), 'k': event_type, 'x': value, 't': t})
   else list_transform(held, lambda z: case when z.g = hit then {'g': z.g, 'k': z.k, 'x': value, 't': t} else z end) end
 from (select e.*, r.held, list_max(list_transform(list_filter(r.held[-12:], lambda z: z.k = e.event_type and abs(z.x - e.value) < 40 and e.t - z.t < 259200), lambda z: z.g)) as hit from r join e on e.user_id = r.user_id and e.n = r.n + 1))
select event_id, first_value(event_id) over (partition by user_id, g order by n) as first_event from r"""
)
def greedy_groups(spark, sf_dir):
    """Each event joins the newest open group of its kind near its value, within three days."""
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type", "t", "value", F.lit(0.0).alias("zero"))
    got = groups.last_near(e, ["user_id"], "event_type", "value", "zero", "t", ["event_id"], 40.0, 259_200.0)
    first = got.groupBy("user_id", "_part", "group").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("first_event"))
    return got.join(first, ["user_id", "_part", "group"]).select("event_id", "first_event")


@query(
    _ORDERED
    + """, r as (select user_id, n, event_id, cast(1 as bigint) as g, [{'g': cast(1 as bigint), 'a': value - 8, 'b': value + 8, 't': t}] as held from e where n = 1
 union all select user_id, n, event_id, coalesce(hit, len(held) + 1), case when hit is null then list_append(held, {'g': cast(len(held) + 1 as bigint), 'a': value - 8, 'b': value + 8, 't': t})
   else list_transform(held, lambda z: case when z.g = hit then {'g': z.g, 'a': least(z.a, value - 8), 'b': greatest(z.b, value + 8), 't': t} else z end) end
 from (select e.*, r.held, list_min(list_transform(list_filter(r.held, lambda z: e.t - z.t < 172800 and e.value - 8 < z.b and e.value + 8 > z.a), lambda z: z.g)) as hit from r join e on e.user_id = r.user_id and e.n = r.n + 1))
select event_id, first_value(event_id) over (partition by user_id, g order by n) as first_event from r"""
)
def greedy_bands(spark, sf_dir):
    """Each event joins the oldest group whose band of values it meets, within two days."""
    e = events(spark, sf_dir).select("user_id", "event_id", "t", (F.col("value") - 8).alias("low"), (F.col("value") + 8).alias("high"))
    got = groups.first_overlapping(e, ["user_id"], "t", "low", "high", ["event_id"], 172_800.0)
    first = got.groupBy("user_id", "_part", "group").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("first_event"))
    return got.join(first, ["user_id", "_part", "group"]).select("event_id", "first_event")


@query(
    """with o as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_returnflag) as q, list(l_returnflag order by l_linenumber, l_quantity, l_returnflag) as f from lineitem group by all)
, s as (select o_custkey, o_orderkey, epoch(o_orderdate) / 86400 as day, q, f from orders join o on o_orderkey = l_orderkey)
, p as (select *, lag(day) over w as day0, lag(q) over w as q0, lag(f) over w as f0 from s window w as (partition by o_custkey order by day, o_orderkey))
, k as (select *, k * 20 / (day - day0) as t from p, range(1, 6) r(k) where day - day0 > 20 and day - day0 <= 100 and k * 20 < day - day0)
, u as (select *, unnest(range(1, greatest(len(q), len(q0)) + 1)) as i from k)
select o_custkey, round(day0 + (day - day0) * t, 6) as day, i - 1 as place, round(coalesce(q0[i] + (q[i] - q0[i]) * t, q0[i], q[i]), 6) as quantity,
  case when t < 0.5 then coalesce(f0[i], f[i]) else coalesce(f[i], f0[i]) end as flag from u"""
)
def blend_rows(spark, sf_dir):
    """Rows between a customer's orders up to a hundred days apart, with the orders' lines blended place by place."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"), "l_returnflag"))).alias("l"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = o.select("o_custkey", "o_orderkey", (F.unix_timestamp("o_orderdate") / 86400).alias("day"), F.col("l.q").alias("quantity"), F.col("l.l_returnflag").alias("flag"))
    gap = F.col("day") - F.col("prev.day")
    made = session.blend_rows(rows.withColumn("at", F.col("day")), ["o_custkey"], ["day", "o_orderkey"], gap, 20.0, ["at"], ["quantity"], ["flag"], gap <= 100)
    each = made.select("o_custkey", "at", F.posexplode(F.arrays_zip("quantity", "flag")).alias("place", "v"))
    return each.select("o_custkey", r6("at").alias("day"), F.col("place").cast("long").alias("place"), r6("v.quantity").alias("quantity"), F.col("v.flag").alias("flag"))


@query(
    """with i as (select user_id, min(epoch(ts)) as low, min(epoch(ts)) + 86400 * (1 + min(user_id) % 9) as high from events group by user_id), e as (select event_id, epoch(ts) as at from events)
select i.user_id, count(*) as n, min(e.event_id) as first_event from i join e on e.at between i.low and i.high group by all"""
)
def overlap_by_ranks(spark, sf_dir):
    """How many events of anybody lie in each user's first days, and the least of their ids, by ranks instead of pairs."""
    e = events(spark, sf_dir).select("event_id", "user_id", "t")
    days = e.groupBy("user_id").agg(F.min("t").alias("low"), (F.min("t") + 86400 * (1 + F.col("user_id") % 9)).alias("high"))
    got = overlap.overlap_summary(days, e, "low", "high", "t", "event_id", rows=SMALL)
    return got.select("user_id", "n", F.col("least").alias("first_event"))


def _files(spark, sf_dir, make):
    """(path, content): a file of each thousand events, made by make(rows) in the tasks that hold them."""

    def run(table_: pa.Table) -> pa.Table:
        rows = sorted(table_.to_pylist(), key=lambda r: r["event_id"])
        return pa.table({"path": [f"/made/{rows[0]['file']}"], "content": pa.array([make(rows)], pa.binary())})

    e = events(spark, sf_dir).select("event_id", "event_type", "value", "t", F.floor(F.col("event_id") / 1000).alias("file"))
    return e.groupBy("file").applyInArrow(run, "path string, content binary")


def _recording(rows: list[dict]) -> bytes:
    kinds = {"view": 0, "click": 5, "purchase": 9}
    return synthetic.sonar_file([{"time_ms": r["event_id"] * 10, "lon": 0.0, "lat": 0.0, "depth_m": 1.0, "channel": kinds.get(r["event_type"], 7), "max_range_m": 0.3048 * 8, "samples": bytes([r["event_id"] % 251] * (r["event_id"] % 40))} for r in rows])


@query(
    """with e as (select event_id, event_id // 1000 as file, case event_type when 'view' then 0 when 'click' then 5 when 'purchase' then 9 else 7 end as channel, event_id % 40 as held from events)
, s as (select *, case when channel <= 5 then 168 else 128 end as header from e), p as (select *, 8 + coalesce(sum(header + held) over (partition by file order by event_id rows between unbounded preceding and 1 preceding), 0) as place from s)
select cast(file as varchar) as recording_id, cast(place as bigint) as "offset", cast(header + held as int) as size, cast(channel as int) as channel, row_number() over (partition by file order by event_id) - 1 as "index", 8.0::double as max_range_ft, event_id * 10 as time_ms,
  cast(place + header as bigint) as ping_offset, cast(held as int) as ping_size, cast(held * (event_id % 251) as bigint) as total from p"""
)
def recording_scan(spark, sf_dir):
    """Recordings made of all events, a thousand a file, scanned with their samples."""
    from fathom.operators.arrays import bytes_of

    got = frames_from_files(_files(spark, sf_dir, _recording), samples=True)
    total = F.aggregate(bytes_of(F.col("samples")), F.lit(0), lambda a, x: a + x)
    return got.select("recording_id", "offset", "size", "channel", "index", F.round("max_range_ft", 6).alias("max_range_ft"), "time_ms", "ping_offset", "ping_size", total.cast("long").alias("total"))


def _log(rows: list[dict]) -> bytes:
    return synthetic.log_file([{"t": 2300 * 604_800 + r["event_id"], "lon": (r["event_id"] % 3600) / 10 - 180, "lat": (r["event_id"] % 1700) / 10 - 85, "status": r["event_id"] % 6, "instance": int(r["event_id"] % 11 == 0), "alt": r["event_id"] % 500, "speed": 0.5} for r in rows], b"\xa3\x95\x07junk")


@query(
    """select cast(event_id // 1000 as varchar) as recording_id, (2300 * 604800 + event_id)::double as absolute_t, round((event_id % 3600) / 10 - 180, 6) as lon, round((event_id % 1700) / 10 - 85, 6) as lat,
  round((event_id % 500)::double, 2) as altitude_m, cast(event_id % 6 as int) as status from events where event_id % 6 >= 3 and event_id % 11 <> 0"""
)
def log_scan(spark, sf_dir):
    """Logs made of all events, a thousand a file, with junk between packets; fixes of the first receiver."""
    files = _files(spark, sf_dir, _log).withColumn("log_ordinal", F.lit(0))
    return fixes_from_files(files).select("recording_id", "absolute_t", r6("lon").alias("lon"), r6("lat").alias("lat"), F.round("altitude_m", 2).alias("altitude_m"), "status")
