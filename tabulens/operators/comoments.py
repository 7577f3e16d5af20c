"""Moments of all pairs of columns in one read of a table, by partial moments that merge.

Every task keeps, for W columns, W * W counts, means and central products over the rows that have both values of a pair,
whatever its rows. Partial moments of tasks merge by the deviations of their means from the joint mean, so nothing is
subtracted that is much larger than what is left. Missing values and columns of any number follow the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.sources.workdir import stored

#: Spread below this share of the mean is rounding: the column is constant.
ROUNDING = 1e-14
MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


class _Sums:
    """Sums of the rows of one task, taken off the means of its first batch."""

    def __init__(self, first: np.ndarray) -> None:
        there = ~np.isnan(first)
        self.shift = np.where(there, first, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        width = first.shape[1]
        self.n, self.x, self.xx, self.xy = (np.zeros((width, width)) for _ in range(4))

    def add(self, v: np.ndarray) -> None:
        there = (~np.isnan(v)).astype(float)
        v = np.where(there > 0, v - self.shift, 0.0)
        self.n += there.T @ there
        self.x += v.T @ there  # of the row's column, over the rows that have the other one too
        self.xx += (v * v).T @ there
        self.xy += v.T @ v

    def moments(self) -> pd.DataFrame:
        """Per pair of columns: rows, both means, and central products."""
        i, j = np.triu_indices(len(self.shift))
        n = self.n[i, j]
        each = np.maximum(n, 1)
        dx, dy = self.x[i, j] / each, self.x[j, i] / each
        products = {"xx": self.xx[i, j] - n * dx * dx, "yy": self.xx[j, i] - n * dy * dy, "xy": self.xy[i, j] - n * dx * dy}
        return pd.DataFrame({"i": i, "j": j, "n": n, "x": self.shift[i] + dx, "y": self.shift[j] + dy, **products})[n > 0]


def merged(partial: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Partial moments of each key as one: means weighed by rows, products with what the means lie apart."""
    joint = partial.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("_x"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("_y"),
        F.min("x").alias("_low_x"), F.max("x").alias("_high_x"), F.min("y").alias("_low_y"), F.max("y").alias("_high_y"),
    )
    # Equal means stay the mean itself, so that constant columns keep products of zero.
    dx = F.when(F.col("_low_x") < F.col("_high_x"), F.col("x") - F.col("_x")).otherwise(0.0)
    dy = F.when(F.col("_low_y") < F.col("_high_y"), F.col("y") - F.col("_y")).otherwise(0.0)
    n = F.col("n")
    each = partial.join(joint, list(keys)).select(
        *keys, "n", "_x", "_y", (F.col("xx") + n * dx * dx).alias("xx"), (F.col("yy") + n * dy * dy).alias("yy"), (F.col("xy") + n * dx * dy).alias("xy")
    )
    return each.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_x").alias("x"), F.first("_y").alias("y"), *[F.sum(c).alias(c) for c in ("xx", "yy", "xy")]
    )


def partial_moments(df: DataFrame, values: list[Column]) -> DataFrame:
    """``i, j, n, x, y, xx, yy, xy`` of each task: for pairs of columns by number, i = j among them. NaN counts as missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            v = batch.to_numpy(float)
            if len(v):
                sums = sums or _Sums(v)
                sums.add(v)
        if sums:
            yield sums.moments()

    numbers = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    return numbers.mapInPandas(run, "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS))


def co_moments(df: DataFrame, values: list[Column]) -> DataFrame:
    """The same over the whole table; the table is read once, what tasks found goes through the shared folder."""
    return merged(stored(partial_moments(df, values), "moments"))


def correlation(moments: DataFrame) -> Column:
    """Pearson's r of merged moments; null without spread in either column."""
    varies = lambda c, mean: F.col(c) > F.col("n") * F.pow(F.abs(F.col(mean)) * F.lit(ROUNDING), F.lit(2.0))
    spread = F.sqrt(F.greatest("xx", F.lit(0.0))) * F.sqrt(F.greatest("yy", F.lit(0.0)))
    return F.when(varies("xx", "x") & varies("yy", "y"), F.try_divide(F.col("xy"), spread))
