"""Whitening against a plain covariance and LAPACK's eigenvectors, the moments' formulas, and odd rows."""

import math

import numpy as np
import pytest

from fathom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, x string"


def plain(rows, most=16):
    x = [(i, [math.floor(64 * float(np.float32(v))) + 1_000_000 for v in e]) for i, e in rows]
    listed = sorted({tuple(v) for _, v in x})
    n, sums = len(listed), [sum(v) for v in zip(*listed, strict=True)]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in listed])
    cov = sum(np.outer(r, r) for r in centred) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(most, int((values > values[0] * len(values) * np.finfo(float).eps).sum()))
    out = {}
    for i, v in x:
        dev = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        w = np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) @ vectors[:k].T / np.sqrt(values[:k])
        out[i] = (n, dev, w, values[:k] / np.trace(cov))
    return out


def compare(got, want, alone=None):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want)
    ids = sorted(want, key=lambda i: -1 if i is None else i)
    k = len(want[ids[0]][2])
    mine = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)][:k] for i in ids])
    theirs = np.array([want[i][2] for i in ids])
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * sign).max() < 1e-7
    for i in ids:
        assert {r.component for r in by[i]} == set(range(1, k + 1))
        assert {(r.n, r.deviation) for r in by[i]} == {want[i][:2]}
        assert np.allclose([r.explained for r in sorted(by[i], key=lambda r: r.component)[:k]], want[i][3], rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_equal_to_a_plain_covariance(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.query(table.repartition(7)).collect()
    compare(got, plain([(r.vec_id, r.embedding) for r in table.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(0, 1, 20) * np.arange(1, 21)).astype(np.float32).tolist()) for i in range(90)]
    good += [(500, good[0][1]), (None, good[1][1])]
    bad = [(100, None), (101, []), (104, [0.0] * 19 + [None]), (105, [0.0] * 19 + [math.nan]), (106, [math.inf] + [0.0] * 19), (107, [1.0] * 64)]
    table = spark.createDataFrame([(i, e, "n", "c", "x") for i, e in good + bad + [(89, good[89][1])]], SCHEMA)
    got = whitening.query(table).collect()
    assert len(got) == 16 * (len(good) + 1)
    compare([r for r in got if r.vec_id != 89] + [r for r in got if r.vec_id == 89][:16], plain(good))
    assert whitening.query(table.limit(0)).count() == 0
    assert whitening.query(table.where("vec_id = 100")).count() == 0
    assert whitening.query(table.where("vec_id = 0")).count() == 0  # one vector has no variance


def test_fewer_components_where_vectors_depend_on_each_other(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [*(a := rng.integers(-50, 50, 3)).astype(float).tolist(), float(a[0] + a[1]), float(a[2]), 1.0]) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-8
    compare(got, plain(rows))


def test_deviations_beyond_a_long_are_null():
    model = whitening.Model(1 << 30, [0, 0], np.ones(1), np.ones((1, 2)), 1.0)
    assert model.deviations(np.array([[1, 1], [2, 1], [2, 2], [1 << 40, 0]])) == [2 << 60, 5 << 60, None, None]
    near = whitening.Model(1, [0], np.ones(1), np.ones((1, 1)), 1.0)
    assert near.deviations(np.array([[3037000499], [3037000500]])) == [3037000499**2, None]


def test_merged_moments_are_those_of_one_stream():
    x = np.random.default_rng(0).normal(5, 2, (300, 6))
    one, parts = whitening.Moments(6), [whitening.Moments(6) for _ in range(4)]
    for k, row in enumerate(x):
        one.add(row)
        parts[min(k // 7, 2)].add(row)  # uneven, the last one empty
    both = whitening.Moments(6)
    for p in parts:
        both.merge(p.n, p.mean, p.comoments)
    assert both.n == 300 and np.allclose(both.mean, x.mean(axis=0), atol=1e-13)
    assert np.allclose(both.covariance(), np.cov(x.T, bias=True), atol=1e-12) and np.allclose(both.covariance(), one.covariance(), atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (np.zeros((n, n)), np.eye(n), np.diag(np.arange(n)).astype(float), np.ones((n, n)), (b := rng.normal(size=(n, n))) + b.T, b @ b.T * 1e8):
        values, vectors = whitening.symmetric_qr(a)
        scale = max(1.0, np.abs(a).max())
        assert (np.diff(values) <= 1e-12 * scale).all() and np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n * scale)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-13 * n) and np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-12 * n * scale)
