"""Deduplication, deterministic samples, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.geo import finite
from fathom.operators.skew import maybe_broadcast
from fathom.session import cut


def first_of_each(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row by order for each key."""
    names = df.columns
    rows = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(rows).select("_row.*")


def ordinal(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def even_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Up to k rows of each key, those at floor(i*(n-1)/(k-1)) in order; all rows of a shorter key."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    last, i = F.col("_n") - 1, F.col("_i")
    # Row i is taken iff some j has floor(j*last/(k-1)) = i: the least j with j*last/(k-1) >= i will do.
    j = F.ceil(i * (k - 1) / F.greatest(last, F.lit(1)))
    taken = (F.col("_n") <= k) | ((F.floor(j * last / (k - 1)) == i) & (j <= k - 1))
    return ranked.where(taken).drop("_i", "_n")


def stride_sample(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of each key, from the first."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.where(F.col("_i") % step == 0).drop("_i")


def farthest_points(df: DataFrame, keys: list[str], x: str, y: str, time: str, k: int = 8, apart: float = 30.0) -> DataFrame:
    """Up to k rows of each key: the first by time, then each time the row farthest from all chosen ones, the first by time among
    equals, none within `apart` of a chosen one in time. Each choice reads all rows of all keys beside the few chosen ones of
    their key, so a key may have any number of rows. Rows without a time or a finite place are not chosen."""
    row = F.struct(*[F.col(c) for c in df.columns])
    own = F.struct(F.col(time).alias("t"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y"))
    held = cut(df.select(F.struct(*keys).alias("_key"), row.alias("_row"), own.alias("_p")).where("_p.t is not null and _p.x is not null and _p.y is not null"))
    pick = F.struct("_p", "_row")
    chosen = cut(held.groupBy("_key").agg(F.array(F.min_by(pick, "_p")).alias("_chosen")))
    n = chosen.count()
    for _ in range(k - 1):
        met = held.join(maybe_broadcast(chosen, n, k * 128), "_key")
        free = F.forall("_chosen", lambda c: F.abs(F.col("_p.t") - c["_p"]["t"]) >= apart)
        dx, dy = (lambda c, d=d: F.col(f"_p.{d}") - c["_p"][d] for d in "xy")
        far = F.array_min(F.transform("_chosen", lambda c: F.sqrt(dx(c) * dx(c) + dy(c) * dy(c))))
        best = cut(met.where(free).groupBy("_key").agg(F.min_by(pick, F.struct((-far).alias("far"), "_p")).alias("_best")))
        if best.isEmpty():
            break
        chosen = cut(chosen.join(best, "_key", "left").select("_key", F.when(F.col("_best").isNull(), F.col("_chosen")).otherwise(F.concat("_chosen", F.array("_best"))).alias("_chosen")))
    return chosen.select(F.explode("_chosen").alias("_c")).select("_c._row.*")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return ordinal(df, keys, order, name)


def within_budget(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every so-many-th row of each key, from the first, by the least step that leaves the key `most` rows or fewer."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")
