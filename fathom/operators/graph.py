"""Links, components, line fits and greedy groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.skew import join_with_hot_keys
from fathom.session import cut, ready


#: Edges that a task contracts at a time.
EDGES_PER_TASK = 250_000


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that the links a-b reach: hooks to smaller roots, and halved paths."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, contracted: each node beside the least one of its block of edges."""

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks])
        nodes, at = np.unique(ends.to_numpy(), return_inverse=True)
        root = least_reachable(at[: len(edges)], at[len(edges) :], len(nodes))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[x], type=ends.type) for x in (other, root[other])], names=["hi", "lo"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= EDGES_PER_TASK:
            yield contract(held)
            held = []
    if held:
        yield contract(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable; lonely nodes aren't returned. Nodes are longs or strings.

    Each task first contracts its own edges. While there are more edges than one task takes,
    alternating large-star and small-star rounds follow, each written to the checkpoint folder, so
    the number of rounds grows with the logarithm of a component's size; a hub's edges are dealt
    out by broadcasting the few hubs.
    """
    schema = edges.select(F.col(a).alias("hi"), F.col(b).alias("lo")).schema

    def contracted(e: DataFrame) -> DataFrame:
        return cut(e.mapInArrow(_stars, schema))

    ready(edges.sparkSession)
    e = contracted(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo"))
    before = None
    while True:
        parts = max(1, -(-e.count() // EDGES_PER_TASK))
        e = contracted(e.coalesce(parts))
        if parts == 1:
            break
        ends = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_with_hot_keys(ends, least, "u", "n", 2 * parts * EDGES_PER_TASK).where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        e = cut(small.select("hi", F.col("m").alias("lo")).unionByName(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def cell_links(points: DataFrame, id_col: str, x: str, y: str, cell: float, near: Column) -> DataFrame:
    """(a, b): pairs a < b from the same or a neighbouring cell for which `near` holds of p and q."""
    i, j = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    body = F.struct(*points.columns)
    left = points.withColumn("_i", F.explode(F.transform(steps, lambda d: i + d))).withColumn("_j", F.explode(F.transform(steps, lambda d: j + d))).select("_i", "_j", body.alias("p"))
    right = points.select(i.alias("_i"), j.alias("_j"), body.alias("q"))
    return left.join(right, ["_i", "_j"]).where(F.col(f"p.{id_col}") < F.col(f"q.{id_col}")).where(near).select(F.col(f"p.{id_col}").alias("a"), F.col(f"q.{id_col}").alias("b")).distinct()


def merge_lines(lines: DataFrame, gap: float, lateral: float) -> DataFrame:
    """(id, root): lines (id, x1, y1, x2, y2, angle) that continue each other.

    Two lines belong together when an end of each lies within gap, their angles differ by at most
    15 degrees and the joint lies within `lateral` of the first one's direction. Ends are hashed to
    cells of size gap, so the pairs come from an equi-join.
    """
    ends = lines.withColumn("_e", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))).select("id", "angle", F.col("_e.x").alias("x"), F.col("_e.y").alias("y"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    turn = F.abs(F.pmod(F.col("q.angle") - F.col("p.angle") + F.lit(90.0), F.lit(180.0)) - 90.0)
    side = F.abs(dy * F.cos(F.radians("p.angle")) - dx * F.sin(F.radians("p.angle")))
    links = cell_links(ends, "id", "x", "y", gap, (F.sqrt(dx * dx + dy * dy) <= gap) & (turn <= 15.0) & (side <= lateral))
    roots = connected_components(links)
    return lines.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def line_fit(points: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(keys, n, cx, cy, angle, low, high, rms): weighted principal axis, the extent along it and the rms beside it."""
    w = F.col(weight)
    total = points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), (F.sum(w * F.col(x)) / F.sum(w)).alias("cx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("cy"))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    moments = points.join(total, keys).groupBy(*keys).agg(F.sum(w * dx * dx).alias("_a"), F.sum(w * dx * dy).alias("_b"), F.sum(w * dy * dy).alias("_d"))
    axis = total.join(moments, keys).withColumn("angle", 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_d")))
    along = dx * F.cos("angle") + dy * F.sin("angle")
    beside = dy * F.cos("angle") - dx * F.sin("angle")
    ends = points.join(axis, keys).groupBy(*keys).agg(F.min(along).alias("low"), F.max(along).alias("high"), F.sqrt(F.sum(w * beside * beside) / F.sum(w)).alias("rms"))
    return axis.drop("_w", "_a", "_b", "_d").join(ends, keys)


def drop_echoes(lines: DataFrame, id_col: str, key: list[str], along: str, strength: str, reach: float, beside: Column) -> DataFrame:
    """Lines without a stronger one beside them: one anti join by buckets of the along distance, which stops
    at a line's first echo and makes no pairs.

    `beside` is a condition on the structs p (the line) and q (the other one).
    """
    bucket = F.floor(F.col(along) / reach)
    left = lines.select(*[F.col(c).alias(f"_p_{c}") for c in key], bucket.alias("_p_bucket"), F.struct(*lines.columns).alias("p"))
    # The other side's copies are narrow where Spark prunes the columns of q that no condition reads.
    right = lines.select(*[F.col(c).alias(f"_q_{c}") for c in key], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_q_bucket"), F.struct(*[c for c in lines.columns if c != id_col]).alias("q"))
    close = F.abs(F.col(f"p.{along}") - F.col(f"q.{along}")) <= reach
    echo = close & (F.col(f"q.{strength}") > F.col(f"p.{strength}")) & beside
    for c in [*key, "bucket"]:
        echo = (F.col(f"_p_{c}") == F.col(f"_q_{c}")) & echo
    return left.join(right, echo, "left_anti").select("p.*")


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, at: str, bucket: float, margin: float = 0.0) -> DataFrame:
    """Rows of left (an interval low..high) with the rows of right whose point lies inside, by buckets of the axis."""
    first, last = F.floor((F.col(low) - margin) / bucket), F.floor((F.col(high) + margin) / bucket)
    spread = left.withColumn("_k", F.explode(F.sequence(first, last)))
    held = right.withColumn("_k", F.floor(F.col(at) / bucket))
    return spread.join(held, "_k").where((F.col(at) >= F.col(low) - margin) & (F.col(at) <= F.col(high) + margin)).drop("_k")


def outside_rectangles(points: DataFrame, rectangles: DataFrame, keys: list[str], along: str, across: str, cell: float) -> DataFrame:
    """Points in no rectangle (keys, low, high on the first axis, left, right on the second) of their key, borders included: one
    anti join by cells of the first axis, which makes no pairs. A point with a null on either axis is in none."""
    spread = rectangles.where("low <= high and left <= right").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))))
    held = spread.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_cell").alias("_r_cell"), *[F.col(c).alias(f"_r_{c}") for c in ("low", "high", "left", "right")])
    inside = F.col(along).between(F.col("_r_low"), F.col("_r_high")) & F.col(across).between(F.col("_r_left"), F.col("_r_right"))
    for k in keys:
        inside = (F.col(k) == F.col(f"_r_{k}")) & inside
    placed = points.withColumn("_cell", F.floor(F.col(along) / cell))
    return placed.join(held, (F.col("_cell") == F.col("_r_cell")) & inside, "left_anti").drop("_cell")
