"""Groups that depend on order: each row joins a group that its predecessors have left open, or founds one.

A row can only join a group whose last row is less than `lapse` before it. So a key's rows are cut wherever two
neighbours lie that far apart: no group reaches across, the parts are folded side by side, and the fold keeps no more than
the groups still open. What it finds equals one loop over all rows, chains included, where components would join more.

Rows without a place in the order (null) found groups of their own. Ties are taken by `order`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts(df: DataFrame, keys: list[str], along: str, order: list[str], lapse: float, name: str = "_part") -> DataFrame:
    """df with the number of its part: a new one begins where the row before is `lapse` or more behind."""
    w = Window.partitionBy(*keys).orderBy(along, *order)
    apart = F.coalesce(F.col(along) - F.lag(along).over(w) >= lapse, F.lit(True)) | F.col(along).isNull()
    return df.withColumn("_apart", apart.cast("int")).withColumn(name, F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")


def folded(df: DataFrame, keys: list[str], along: str, order: list[str], lapse: float, fold: Callable[[pd.DataFrame], np.ndarray], name: str) -> DataFrame:
    """df with `name`, the place of each row's group in its part (0 for the part's first group), and _part."""
    cut = parts(df, keys, along, order, lapse)
    schema = T.StructType([*cut.schema.fields, T.StructField(name, T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([along, *order], kind="stable").reset_index(drop=True)
        return pdf.assign(**{name: fold(pdf)})

    return cut.groupBy(*keys, "_part").applyInPandas(run, schema)


def last_near(df: DataFrame, keys: list[str], kind: str, x: str, y: str, time: str, order: list[str], near: float, lapse: float, recent: int = 12, name: str = "group") -> DataFrame:
    """df with its group, told by _part and `name`: each row joins the newest of the last `recent` groups founded whose last row is of
    its kind, less than `near` away and less than `lapse` before it; else it founds one."""

    def fold(pdf: pd.DataFrame) -> np.ndarray:
        k, px, py, t = (pdf[c].to_numpy() for c in (kind, x, y, time))
        last: list[int] = []  # the last row of every group
        out = np.empty(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            fits = (g for g in range(len(last) - 1, max(-1, len(last) - 1 - recent), -1) if k[last[g]] == k[i] and np.hypot(px[last[g]] - px[i], py[last[g]] - py[i]) < near and t[i] - t[last[g]] < lapse)
            g = next(fits, len(last))
            last[g:] = [i, *last[g + 1 :]] if g < len(last) else [i]
            out[i] = g
        return out

    return folded(df, keys, time, order, lapse, fold, name)


def first_overlapping(df: DataFrame, keys: list[str], along: str, low: str, high: str, order: list[str], lapse: float, name: str = "group") -> DataFrame:
    """df with its group, told by _part and `name`: each row joins the oldest group whose last row is less than `lapse` behind and whose
    band, that of all its rows, meets the row's own low to high (open at both ends); else it founds one."""

    def fold(pdf: pd.DataFrame) -> np.ndarray:
        at, a, b = (pdf[c].to_numpy(dtype=float) for c in (along, low, high))
        out, founded = np.empty(len(pdf), dtype=np.int64), 0
        open_: list[list[float]] = []  # number, last place, low, high of the groups still in reach, oldest first
        for i in range(len(pdf)):
            open_ = [g for g in open_ if at[i] - g[1] < lapse]
            hit = next((g for g in open_ if a[i] < g[3] and b[i] > g[2]), None)
            if hit is None:
                hit = [founded, at[i], a[i], b[i]]
                founded += 1
                open_.append(hit)
            else:
                hit[1:] = [at[i], min(hit[2], a[i]), max(hit[3], b[i])]
            out[i] = hit[0]
        return out

    return folded(df, keys, along, order, lapse, fold, name)
