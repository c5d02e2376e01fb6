"""Centroid clustering against a plain loop, its screening, and odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from fathom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, distance string"


def plain(rows, k=40, rounds=5, seed="2", scale=256):
    """Lloyd's rounds one vector at a time, in Python's integers."""
    kept = [(i, tuple(math.floor(scale * float(np.float32(v))) for v in e)) for i, e in rows]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=mark)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    found = []
    for r in range(rounds + 1):
        found = [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [x for (_, x), (_, f) in zip(kept, found, strict=True) if f == j]
                if own:
                    centres[j] = tuple(sum(v) // len(own) for v in zip(*own, strict=True))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for d, _ in found)
    return sorted((i if i is not None else -1, j, d, sum(e for e, f in found if f == j), total, digest[j]) for (i, _), (d, j) in zip(kept, found, strict=True))


def rows_of(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equal_to_a_plain_loop_and_to_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = rows_of(centroids.query(table))
    assert got == plain([(r.vec_id, r.embedding) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cursor = con.execute(centroids.ORACLE)
    assert [d[0] for d in cursor.description] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got == sorted(cursor.fetchall())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 1 + i % 3, 64).astype(np.float32).tolist()) for i in range(60)]
    good += [(7, good[7][1]), (7, good[7][1]), (None, good[3][1]), (-5, [0.0] * 64), (9, [-1e-9] * 64)]
    bad = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [0.0] * 63 + [None]), (105, [0.0] * 63 + [math.nan]), (106, [math.inf] + [0.0] * 63), (107, [-math.inf] * 64)]
    table = spark.createDataFrame([(i, e, "c", "i", "d") for i, e in good + bad], SCHEMA)
    assert rows_of(centroids.query(table)) == plain(good)
    assert centroids.query(table.limit(0)).count() == 0
    assert centroids.query(table.where("vec_id > 99")).count() == 0
    few = rows_of(centroids.query(table.where("vec_id between 20 and 24")))
    assert few == plain([g for g in good if g[0] is not None and 20 <= g[0] <= 24]) and sum(r[2] for r in few) == 0


def test_huge_components_are_held_at_the_limit(spark):
    table = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in centroids.cluster(table, 1, 1, "2").collect()}
    assert got[1].distance >= 64 * centroids.LIMIT**2 // 4 and got[3].distance >= 0 and len({r.centroid_sha256 for r in got.values()}) == 1


@pytest.mark.parametrize("spread", [0, 1, 300, 1 << 26])
def test_bounds_lose_no_nearest_centroid(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread - 1, spread + 2, (700, 64))
    c = np.concatenate([x[:25], x[:5], rng.integers(-spread - 1, spread + 2, (10, 64))])
    best, far, _ = centroids.nearest(x, centroids.compress(x), c, centroids.compress(c))
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def test_bounds_are_below_distances_and_spare_most_of_them():
    rng = np.random.default_rng(1)
    heart = rng.integers(-900, 900, (40, 64))
    x = heart[rng.integers(0, 40, 2000)] + rng.integers(-30, 31, (2000, 64))
    a, b = centroids.compress(x).astype(float), centroids.compress(heart).astype(float)
    exact = ((x[:, None] - heart[None]) ** 2).sum(axis=2)
    bound = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (bound <= exact * (1 + 1e-6)).all()
    *_, taken = centroids.nearest(x, centroids.compress(x), heart, centroids.compress(heart))
    assert taken < 0.1 * 40 * len(x)
