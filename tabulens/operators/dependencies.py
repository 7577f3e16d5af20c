"""Functional dependencies between categorical columns: violations by task first, then only what none has seen.

A dependency that does not hold is nearly always broken within the rows of one task. There, columns are coded as numbers
and the rows are partitioned by one column's codes at a time; parts of a single row are stripped, as they break nothing.
Pairs broken in any task are out. What is left is grouped by child value over the whole table, each child once with all
parents that it may still determine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.operators.tablefacts import quoted

#: Rows of a task that are looked at together.
TOGETHER = 20_000


def broken_in(codes: np.ndarray, child: int, parents: list[int]) -> list[int]:
    """Of the parents, those with two values beside one value of the child; codes below 0 are missing."""
    rows = codes[codes[:, child] >= 0]
    order = np.argsort(rows[:, child], kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows[:, child], prepend=-1))
    sizes = np.diff(np.append(starts, len(rows)))
    many = np.repeat(sizes > 1, sizes)
    rows, starts = rows[many], (np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1])
    if not len(starts):
        return []
    p = rows[:, parents]
    most = np.maximum.reduceat(p, starts)
    least = np.minimum.reduceat(np.where(p < 0, np.iinfo(p.dtype).max, p), starts)
    return [parent for parent, broken in zip(parents, ((most >= 0) & (least < most)).any(axis=0)) if broken]


def broken_pairs(rows: DataFrame, pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Of the pairs (parent, child) of column numbers, those that the rows of some task break."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = set(pairs)
        for batch in batches:
            for low in range(0, len(batch) if left else 0, TOGETHER):
                codes = np.column_stack([pd.factorize(batch[c].iloc[low : low + TOGETHER])[0] for c in batch.columns])
                found = []
                for child in sorted({b for _, b in left}):
                    found += [(a, child) for a in broken_in(codes, child, sorted(a for a, b in left if b == child))]
                left -= set(found)
                if found:
                    yield pd.DataFrame(found, columns=["parent", "child"])

    found = rows.mapInPandas(run, "parent int, child int").distinct()
    return {(r.parent, r.child) for r in found.collect()}  # pairs of columns, whatever the rows


def hierarchy_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``parent, child, holds`` for every earlier column and later column of the list.

    The child determines the parent if no child value occurs with two parent values. Groups keep only the least and
    greatest parents, so nothing grows with the data; rows collapse per child value before the exchange. A pair that a
    task has seen broken is not grouped at all.
    """
    schema = "parent string, child string, holds boolean"
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    broken = broken_pairs(rows, pairs)
    left = [p for p in pairs if p not in broken]
    out = df.sparkSession.createDataFrame([(columns[a], columns[b], False) for a, b in pairs if (a, b) in broken], schema)
    if not left:
        return out
    parents = sorted({a for a, _ in left})
    items = [
        F.struct(F.lit(child).alias("child"), F.col(f"c{child}").alias("value"), *[(F.col(f"c{a}") if (a, child) in left else F.lit(None).cast("string")).alias(f"p{a}") for a in parents])
        for child in sorted({b for _, b in left})
    ]
    ends = [f(f"p{a}").alias(f"{name}{a}") for a in parents for name, f in (("low", F.min), ("high", F.max))]
    groups = rows.select(F.inline(F.array(*items))).where("value is not null").groupBy("child", "value").agg(*ends)
    holds = [(F.bool_and(F.coalesce(F.col(f"low{a}") == F.col(f"high{a}"), F.lit(True))) & (F.count(f"low{a}") > 0)).alias(f"h{a}") for a in parents]
    each = groups.groupBy("child").agg(*holds).select("child", F.inline(F.array(*[F.struct(F.lit(a).alias("parent"), F.col(f"h{a}").alias("holds")) for a in parents])))
    named = df.sparkSession.createDataFrame([(a, b, columns[a], columns[b]) for a, b in left], "a int, b int, parent string, child string")
    each = each.select(F.col("parent").alias("a"), F.col("child").alias("b"), "holds")
    return out.unionByName(named.join(each, ["a", "b"], "left").select("parent", "child", F.coalesce("holds", F.lit(False)).alias("holds")))
