"""Online operators over files that arrive as a stream."""

import pytest
from pyspark.sql import functions as F

from fathom.streaming import events as online


def through(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


@pytest.fixture
def arrivals(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    last = batch.agg(F.max("ts")).first()[0]
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    # A late row closes all windows.
    spark.createDataFrame([(-1, last, -1, "end", 0.0)], batch.schema).withColumn("ts", F.col("ts") + F.expr("interval 30 days")).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windowed_counts(spark, arrivals):
    batch, stream = arrivals
    got = {tuple(r) for r in through(spark, online.windowed_counts(stream, "ts", "event_type"), "counts") if r.event_type != "end"}
    want = {tuple(r) for r in online.windowed_counts(batch, "ts", "event_type").collect()}
    assert got == want


def test_sessions(spark, arrivals):
    batch, stream = arrivals
    got = {tuple(r) for r in through(spark, online.sessions(stream, "ts", "user_id"), "runs") if r.user_id != -1}
    assert got == {tuple(r) for r in online.sessions(batch, "ts", "user_id").collect()}


def test_online_interpolation(spark, tmp_path):
    rows = [("k", 0.0, 0, "fix", 0.0), ("k", 0.5, 1, "probe", None), ("k", 1.0, 2, "fix", 10.0), ("k", 1.0, 3, "probe", None), ("k", 2.0, 4, "probe", None), ("k", 4.0, 5, "fix", 40.0)]
    df = spark.createDataFrame(rows, "k string, t double, id long, kind string, value double").select("k", F.timestamp_seconds("t").alias("ts"), "id", "kind", "value")
    for part in (df.where("id < 2"), df.where("id >= 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: r.value for r in through(spark, online.interpolate_online(stream, "k"), "online")}
    assert got == {1: 5.0, 3: 10.0}
