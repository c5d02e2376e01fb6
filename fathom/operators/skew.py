"""Joins whose one side may hold most of its rows under a few keys, and broadcasts of a proven size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows times a generous row width must stay under this for a side to be broadcast.
BROADCAST_BYTES = 8 << 20


#: Narrow rows that a task should have at least; a counted table is read back in no more parts than that.
PART_ROWS = 20_000


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint only where the counted rows prove the size; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 256) -> DataFrame:
    """Left join on a key that is unique in right, where a few keys may hold most left rows.

    right carries in `weight` how many left rows each key has, and total is their sum, so at
    most `share` keys can exceed total/share: those are broadcast and the rest is shuffled.
    """
    limit = total / share
    mark = "_hot"
    while mark in (*left.columns, *right.columns):
        mark = f"_{mark}"
    hot = right.where(F.col(weight) > limit).drop(weight).withColumn(mark, F.lit(True))
    cold = right.where(F.col(weight) <= limit).drop(weight)
    marked = left.join(F.broadcast(hot), key, "left")
    names = [c for c in cold.columns if c != key]
    done = marked.where(F.col(mark)).drop(mark)
    rest = marked.where(F.col(mark).isNull()).drop(mark, *names).join(cold, key, "left")
    return done.unionByName(rest)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, row_bytes: int, weight: str, total: int) -> DataFrame:
    """Left join on a key that is unique in right: right is broadcast whole where its counted rows prove
    it small, else only its hot keys are (see join_with_hot_keys)."""
    if rows * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(weight)), key, "left")
    return join_with_hot_keys(left, right, key, weight, total)
