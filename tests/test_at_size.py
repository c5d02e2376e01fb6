"""What showed only on larger tables or larger numbers, in small."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom import queries
from fathom.operators import asof, nearest


def same_as_sql(spark, folder, name):
    """Whether the query's rows over the tables in the folder are those of its SQL."""
    df = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_positions_round_as_their_sql_far_out(spark, tmp_path):
    """Distances whose thousandths end so near a half that the product with 1,000 lies on it; a balance of nothing."""
    rows = [(39007372, 8559.52), (39011112, 3504.58), (39011341, 3611.18), (630204, 3717.22), (811680, 3717.22), (395020, 3418.2), (1, 0.0), (2, None)]
    many = spark.range(5_000).select((F.col("id") * 7919).alias("c_custkey"), (F.col("id") % 9973 / 1.0).alias("c_acctbal"))
    few = spark.createDataFrame(rows, "c_custkey long, c_acctbal double")
    many.unionByName(few).write.parquet(str(tmp_path / "customer.parquet"))
    assert same_as_sql(spark, tmp_path, "positions")


def test_scaled_rounding(spark):
    values = [2.5, -2.5, 0.49999999999999994, 1e300, -0.5, 4503599627370497.5, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(queries.scaled_round(F.col("v"), 0).alias("r"))
    assert [r.r for r in df.collect()] == [3.0, -3.0, 0.0, 1e300, -1.0, 4503599627370497.5, float("inf"), None]


def plain_nearest(probe, points, within):
    """(order, d2) of the nearest point to (id, x, y), by a plain loop."""
    near = [((probe[1] - x) * (probe[1] - x) + (probe[2] - y) * (probe[2] - y), k) for k, x, y in points if k != probe[0]]
    d2, k = min(near)
    return (k, d2) if d2 <= within * within else (None, None)


@pytest.mark.parametrize("leaf", [3, 32])
def test_divided_cells_find_the_nearest(spark, leaf):
    """Clusters of very unlike widths, copies of a place, ties on a lattice, probes far outside and on points."""
    rnd = random.Random(leaf)
    places = [(rnd.gauss(c, s), rnd.gauss(-c, s)) for c, s in ((0, 1), (5, 1e-9), (1e6, 3)) for _ in range(60)] + [(7.0, 7.0)] * 50 + [(float(i % 9), float(i // 9)) for i in range(81)]
    points = [(k, *p) for k, p in enumerate(places)]
    probes = rnd.sample(points, 60) + [(rnd.choice([-1, 3]), rnd.uniform(-3e6, 3e6), rnd.uniform(-3e6, 3e6)) for _ in range(20)] + [(-2, 3.5, 3.5), (171, 7.0, 7.0), (171, 7.0, 7.0)]
    odd = [(900, None, 1.0), (901, float("nan"), 0.0), (902, float("inf"), 0.0)]
    q, p = (spark.createDataFrame(rows + odd, "id long, x double, y double") for rows in (points, probes))
    for within in (float("inf"), 0.7):
        got = nearest.nearest(p, q, ("x", "y"), ("x", "y"), "id", within, "id", leaf).collect()
        want = [(r[0], r[1], *plain_nearest(r, points, within)) for r in probes] + [(r[0], r[1], None, None) for r in odd]
        assert sorted(str((r.id, r.x, r.near and r.near.order, r.near and r.near.d2)) for r in got) == sorted(map(str, want))


def test_nearest_makes_few_pairs(spark, monkeypatch):
    """Every twentieth of dense points, thirty times as far out too: probes meet a few cells and leaves, not all points."""
    rows = spark.range(20_000).select("id", (F.randn(3) / 8).alias("x"), (F.randn(4) / 8).alias("y"))
    probes = rows.where("id % 20 = 0").unionByName(rows.where("id % 20 = 1").select("id", F.col("x") * 30, F.col("y") * 30).toDF("id", "x", "y"))
    met = []
    kept = nearest._possible
    monkeypatch.setattr(nearest, "_possible", lambda found, itself: met.append(found.count()) or kept(found, itself))
    assert asof.nearest_anywhere(probes, rows, ("x", "y"), ("x", "y"), "id", 0.1, "id").where("near is null").count() == 0
    assert 1 < len(met) < 8 and max(met) < 2000 * 150


def test_first_days_make_no_pairs(spark, tmp_path, monkeypatch):
    """Many users and events of the same days: counted by ranks."""
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 700).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.pmod(F.hash("id"), F.lit(150_000))).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries.graph, "overlap_join", lambda *a, **b: pytest.fail("pairs"))
    assert same_as_sql(spark, tmp_path, "interval_overlap")


def test_farthest_points_of_many_rows_are_those_of_the_sql(spark, tmp_path):
    """More rows of a label than were once kept, copies of places among them."""
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.array((F.pmod(F.hash("id"), F.lit(997)) / 7).cast("float"), (F.pmod(F.xxhash64("id"), F.lit(991)) / 7).cast("float")).alias("embedding"), F.when(F.col("id") < 5900, 0).otherwise(F.col("id") % 2 + 1).cast("int").alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same_as_sql(spark, tmp_path, "farthest_points")
