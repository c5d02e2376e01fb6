"""Every star-schema query against its SQL in DuckDB."""

import collections
import math

import duckdb
import pytest

from fathom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_farthest_points_are_far_and_apart(spark, sf):
    rows = queries.farthest_points(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.label].append(r.vec_id)
    assert by and all(len(v) <= 8 and all(abs(a - b) >= 30 for a in v for b in v if a != b) for v in by.values())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
