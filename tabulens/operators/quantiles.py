"""Exact medians of large columns by a radix select: passes that only count.

Every pass cuts the bracket that holds the middle into buckets by a function that never falls, and counts what lies in
each; the bucket with the middle is the next bracket. A bracket around zero is cut by sign, a wide one by logarithms,
a narrow one evenly, so each pass takes about twelve bits off a double's order and no buffer of values is ever held. A
bracket with few values left is fetched, one with a single distinct value is done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a pass for each column, and the values that a bracket may hold to be fetched.
BUCKETS, FEW = 4096, 10_000


def _bucket(v: Column, low: float, high: float, buckets: int) -> Column:
    """Numbers that do not fall as values grow, for finite or infinite values from ``low`` to ``high`` that differ."""
    if math.isinf(low) or math.isinf(high):
        return F.when(v == F.lit(-math.inf), 0).when(v < F.lit(math.inf), 1).otherwise(2)
    if low <= 0 <= high:
        return F.when(v < 0, 0).when(v == 0, 1).otherwise(2)
    if max(high / low, low / high) > 4:
        sign = 1 if low > 0 else -1
        low, high, v = sign * math.log(abs(low)), sign * math.log(abs(high)), F.lit(sign) * F.log(F.abs(v))
    return F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(buckets))


def exact_medians(df: DataFrame, columns: dict[str, Column], few: int = FEW, buckets: int = BUCKETS) -> dict[str, float | None]:
    """Interpolated median of every numeric expression, as a plain number per name; nulls and NaN are left out."""
    if not columns:
        return {}
    names = list(columns)
    numbers = {f"v{i}": columns[c].cast("double") for i, c in enumerate(names)}
    values = df.select(*[F.when(~F.isnan(x), x).alias(v) for v, x in numbers.items()])
    first = values.agg(*[x.alias(f"{k}{v}") for v in numbers for k, x in (("n", F.count(v)), ("a", F.min(v)), ("b", F.max(v)))]).first()
    found: dict[str, float | None] = {}
    # Of each open column: the bracket, what it holds, and the ranks in it (from 0) whose mean is the median.
    open_columns: dict[str, tuple[float, float, int, int, int]] = {}

    def settle(v: str, low: float, high: float, n: int, r: int, s: int) -> None:
        if low == high:
            found[v] = low
        else:
            open_columns[v] = low, high, n, r, s

    for v in numbers:
        n = first[f"n{v}"]
        settle(v, first[f"a{v}"], first[f"b{v}"], n, (n - 1) // 2, n // 2)
    while open_columns:
        now, open_columns = open_columns, {}
        within = {v: F.col(v).between(F.lit(low), F.lit(high)) for v, (low, high, *_) in now.items()}
        fetched = [v for v in now if now[v][2] <= few]
        cut = [F.when(within[v], F.struct(F.lit(v).alias("c"), (F.col(v) if v in fetched else _bucket(F.col(v), *now[v][:2], buckets)).cast("double").alias("bucket"), F.col(v).alias("x"))) for v in now]
        each = values.select(F.explode(F.array(*cut)).alias("y")).where("y is not null").select("y.*")
        counts = each.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        rows: dict[str, list] = {v: [] for v in now}
        for row in counts.collect():  # ``buckets`` or ``few`` rows for each column
            rows[row.c].append(row)
        for v, (_, _, _, r, s) in now.items():
            before = 0
            for row in sorted(rows[v], key=lambda row: row.bucket):
                if r < before + row.n <= s:  # the two middle values are neighbours in different buckets
                    low = row.high
                elif before <= s < before + row.n:
                    if r < before:
                        found[v] = (low + row.low) / 2
                    else:
                        settle(v, row.low, row.high, row.n, r - before, s - before)
                    break
                before += row.n
    return {c: found[f"v{i}"] for i, c in enumerate(names)}
