"""Centroid clustering of vectors in exact integers, with block-norm screening.

Each component x becomes the integer floor(scale * x). A vector is cut into segments, and for every segment
its mean and the norm of what is left are kept: the compressed vector. By Cauchy-Schwarz the distance of
two compressed vectors is never above that of the vectors themselves, so a centroid whose bound exceeds
the distance to the most promising one can't be the nearest. Only the others get exact integer distances.
Bounds are floating, with a slack far above their rounding; results are exact.

Vectors, centroids and norms never meet on the driver: each round is one narrow pass that leaves counts
and sums for each centroid and task, which Spark adds up; k rows come to the driver. The kept vectors with
their norms are written to the checkpoint folder once, at 320 bytes each for 64 components.

Rows are left out where the vector is null, has another number of components, or a null or non-finite
one. Repeated rows are vectors of their own. A null id is kept; it is drawn as a centroid only after all others.
Components beyond +-2^27 count as +-2^27, since no distance would fit a long; an inertia beyond a long is null.
Of equally near centroids the smaller number wins; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import cut, ready

DIM = 64
SCALE = 256
SEGMENTS = 8
#: Of integers, so that dim * (2 * LIMIT)^2 fits a long for 64 components.
LIMIT = 1 << 27
#: Share of both squared norms that a bound may be too high by; 32-bit norms err by less than a quarter of it.
SLACK = 1e-6
#: Pairs whose exact distances are taken at a time.
PAIRS = 1 << 14


def complete(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all of them finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def compress(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """For each segment the scaled mean and the norm of the rest; the squared norm stays that of x."""
    parts = np.array_split(x.astype(np.float64), segments, axis=1)
    mean = [p.mean(axis=1) for p in parts]
    rest = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, mean, strict=True)]
    return np.stack([m * np.sqrt(p.shape[1]) for p, m in zip(parts, mean, strict=True)] + rest, axis=1).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, short: np.ndarray, c: np.ndarray, c_short: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid, its squared distance, and how many exact distances that took."""
    a, b = short.astype(np.float64), c_short.astype(np.float64)
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    bound = size * (1 - SLACK) - 2 * (a @ b.T)
    rows = np.arange(len(x))
    first = bound.argmin(axis=1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = distances(x, c[first])
    maybe = bound <= exact[rows, first][:, None]
    maybe[rows, first] = False
    row, col = np.nonzero(maybe)
    for k in range(0, len(row), PAIRS):
        i, j = row[k : k + PAIRS], col[k : k + PAIRS]
        exact[i, j] = distances(x[i], c[j])
    best = exact.argmin(axis=1)
    return best, exact[rows, best], len(x) + len(row)


@dataclass
class Model:
    """Centroids by number, as integers."""

    centroids: list[tuple[int, ...]]

    def arrays(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        c = np.array(self.centroids, dtype=np.int64)
        return c, compress(c, segments)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def compressed(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, segments: int = SEGMENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x, short) of the kept vectors: 32-bit integers and 32-bit norms, packed."""
    spark = ready(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            packed = [[r.tobytes() for r in m] for m in (x.astype("<i4"), compress(x, segments).astype("<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p, type=pa.binary()) for p in packed)], names=["id", "x", "short"])

    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(complete(F.col("v"), dim))
    return spark.createDataFrame([], "id long, x binary, short binary") if dim < segments else kept.mapInArrow(run, "id long, x binary, short binary")


def _matrix(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(rows, -1)


def assign(held: DataFrame, model: Model, segments: int = SEGMENTS) -> DataFrame:
    """(id, cluster, distance) of compressed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, c_short = model.arrays(segments)
        for b in (b for b in batches if b.num_rows):
            best, far, _ = nearest(_matrix(b.column(1), "<i4", b.num_rows).astype(np.int64), _matrix(b.column(2), "<f4", b.num_rows), c, c_short)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return held.mapInArrow(run, "id long, cluster int, distance long")


def _moved(held: DataFrame, model: Model, dim: int, segments: int) -> Model:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, c_short = model.arrays(segments)
        count, total = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
        for b in (b for b in batches if b.num_rows):
            x = _matrix(b.column(1), "<i4", b.num_rows).astype(np.int64)
            best, _, _ = nearest(x, _matrix(b.column(2), "<f4", b.num_rows), c, c_short)
            count += np.bincount(best, minlength=len(c))
            np.add.at(total, best, x)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = held.mapInArrow(run, "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(dim)]
    new = list(model.centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid at most
        new[r["cluster"]] = tuple(int(r[f"t{i}"]) // r["n"] for i in range(dim))
    return Model(new)


def fit(held: DataFrame, k: int, rounds: int, seed: str, dim: int = DIM, segments: int = SEGMENTS) -> Model:
    """k centroids, first the vectors with the smallest sha256 of `seed:id`, after so many rounds; fewer if there are fewer vectors."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = held.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    model = Model([tuple(np.frombuffer(r["x"], dtype="<i4").tolist()) for r in first])
    for _ in range(rounds if first else 0):
        model = _moved(held, model, dim, segments)
    return model


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str, dim: int = DIM, scale: int = SCALE, segments: int = SEGMENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = ready(vectors.sparkSession)
    held = cut(compressed(vectors, dim, scale, segments, id_col, vec_col))
    model = fit(held, k, rounds, seed, dim, segments)
    found = cut(assign(held, model, segments)) if model.centroids else held.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    of = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(j, fits(of[j]), fits(sum(of.values())), d) for j, d in enumerate(model.digests()) if j in of]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# Fixed values of the query.
K, ROUNDS, SEED = 40, 5, "2"


def query(vectors: DataFrame) -> DataFrame:
    return cluster(vectors, K, ROUNDS, SEED)


def _oracle() -> str:
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) x from embeddings "
        f"where len(embedding) = {DIM} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {DIM})",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 c, x from kept order by sha256('{SEED}:' || vec_id) limit {K})",
    ]
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select vec_id, x, least.c c, least.d d from (select v.vec_id, v.x, min({{'d': {far}, 'c': c.c}}) least from kept v, c{r} c group by v.vec_id, v.x))")
        if r < ROUNDS:
            steps.append(
                f"c{r + 1} as materialized (select c.c, coalesce(m.x, c.x) x from c{r} c left join (select c, list(s order by i) x from (select c, i, floor_div(sum(v), count(*)) s from "
                f"(select c, unnest(x) v, generate_subscripts(x, 1) i from a{r}) group by c, i) group by c) m using (c))"
            )
    last = f"a{ROUNDS}"
    return (
        "with " + ", ".join(steps).replace("floor_div(sum(v), count(*))", "((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::bigint")
        + f" select vec_id, a.c::int as \"cluster\", d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, "
        f"sha256(array_to_string(c.x, ',')) as centroid_sha256 from {last} a join c{ROUNDS} c using (c)"
    )


ORACLE = _oracle()
