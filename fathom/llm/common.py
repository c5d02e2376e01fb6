"""What the corpus operators share: their tables. Lineage cuts, checked broadcasts and components come from the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.graph import connected_components, least_reachable
from fathom.operators.skew import BROADCAST_BYTES, join_with_hot_keys, lookup, maybe_broadcast, parts_for
from fathom.session import cut, ready

__all__ = ["BROADCAST_BYTES", "connected_components", "cut", "fresh", "join_with_hot_keys", "least_reachable", "let", "lookup", "maybe_broadcast", "parts_for", "ready", "running", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one like it that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body has it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or another associative op) of an array, in doubling steps."""

    def made(first: Column) -> Column:
        steps = F.ceil(F.log2(F.greatest(F.size(first), F.lit(2)))).cast("int")

        def step(acc: Column, k: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i >= back, op(F.get(acc, i - back), x)).otherwise(x))

        return F.aggregate(F.sequence(F.lit(0), steps - 1), first, step)

    return let(values, made)
