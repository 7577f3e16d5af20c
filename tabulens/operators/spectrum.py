"""Periodicity of numeric columns by the discrete Fourier transform of the whole series.

A series is transformed by the four-step method: it is dealt into many short transforms, the results are turned and
dealt again, so no task ever holds more than one short transform, of about the square root of the length. Lengths that cannot be cut evenly go through a chirp convolution of power-of-two length.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.operators.tablefacts import quoted
from tabulens.sources.rows import number_rows

# Columns analysed, shortest series, strength that saturates the score.
MAX_COLUMNS = 5
MIN_POINTS = 20
SATURATION = 5.0


def _two_factors(n: int, limit: int) -> tuple[int, int] | None:
    """``n = a * b`` with both factors at most ``limit``, as even as possible."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= limit else None
    return None


def _short_transforms(df: DataFrame, group: Column, index: Column, size: int, inverse: bool) -> DataFrame:
    """Transform every group of ``size`` points of every series: ``c, g, k, re, im``."""
    transform = np.fft.ifft if inverse else np.fft.fft

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size, complex)
        x[part["i"].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        y = transform(x)
        return pd.DataFrame({"c": key[0], "g": key[1], "k": np.arange(size), "re": y.real, "im": y.imag})

    grouped = df.select("c", group.alias("g"), index.alias("i"), "re", "im").groupBy("c", "g")
    return grouped.applyInPandas(run, "c int, g long, k long, re double, im double")


def _turn(df: DataFrame, angle: Column, *keep: str) -> DataFrame:
    """Multiply by ``exp(i * angle)``."""
    turned = df.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
    return turned.select(
        *keep,
        (F.col("re") * F.col("_c") - F.col("im") * F.col("_s")).alias("re"),
        (F.col("re") * F.col("_s") + F.col("im") * F.col("_c")).alias("im"),
    )


def _four_step(df: DataFrame, a: int, b: int, inverse: bool = False) -> DataFrame:
    """Transforms of ``a * b`` points ``c, pos, re, im`` for each series c; points that are missing are zero."""
    sign = 1.0 if inverse else -1.0
    first = _short_transforms(df, F.col("pos") % a, F.floor(F.col("pos") / a), b, inverse)
    angle = sign * 2.0 * math.pi * ((F.col("g") * F.col("k")) / F.lit(float(a * b)))
    turned = _turn(first, angle, "c", "g", "k")
    second = _short_transforms(turned, F.col("k"), F.col("g"), a, inverse)
    return second.select("c", (F.col("g") + F.lit(b) * F.col("k")).alias("pos"), "re", "im")


def _chirp_angle(pos: Column, n: int) -> Column:
    """``pi * pos^2 / n`` reduced to one turn in exact integers before it becomes a float."""
    square = pos.cast("decimal(19,0)") * pos.cast("decimal(19,0)")
    return math.pi * (F.pmod(square, F.lit(2 * n).cast("decimal(38,0)")).cast("double") / F.lit(float(n)))


def transform_series(series: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    """Transforms of the ``n`` points ``c, pos, re, im`` (positions 0 .. n-1) of each series c, as ``c, pos, re, im``.

    All series go through the same steps at once, and share the filter of the convolution. ``limit`` bounds the points of one short transform; by default it is four times the square root of ``n``.
    """
    factors = _two_factors(n, limit or 4 * math.isqrt(n) + 4)
    if factors:
        return _four_step(series, *factors)
    size = 1 << (2 * n - 2).bit_length()
    half = size.bit_length() - 1
    a, b = 1 << (half // 2), 1 << (half - half // 2)
    chirped = _turn(series, -_chirp_angle(F.col("pos"), n), "c", "pos")
    filter_points = (
        series.sparkSession.range(n)
        .select(F.explode(F.array(F.col("id"), F.when(F.col("id") > 0, F.lit(size) - F.col("id")))).alias("pos"), "id")
        .where(F.col("pos").isNotNull())
        .withColumn("angle", _chirp_angle(F.col("id"), n))
        .select(F.lit(0).alias("c"), "pos", F.cos("angle").alias("re"), F.sin("angle").alias("im"))
    )
    x, y = _four_step(chirped, a, b), _four_step(filter_points, a, b)
    y = y.select("pos", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = x.join(y, "pos").select(
        "c",
        "pos",
        (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
    )
    convolved = _four_step(product, a, b, inverse=True).where(F.col("pos") < n)
    return _turn(convolved, -_chirp_angle(F.col("pos"), n), "c", "pos")


def _strength(spectrum: DataFrame, n: int) -> DataFrame:
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    inner = spectrum.where((F.col("pos") >= 1) & (F.col("pos") < n // 2))
    return inner.groupBy("c").agg(
        F.when(F.avg(size) > 0, F.least(F.lit(1.0), F.max(size) / (SATURATION * F.avg(size)))).alias("periodicity")
    )


def column_periodicity(df: DataFrame, columns: list[str], order: str, limit: int | None = None) -> DataFrame:
    """``column, points, periodicity`` of the first five numeric columns in row order.

    Null for a constant column; columns of fewer than 20 values are left out, as the reference quantity is
    defined from there on. Columns without a missing value are numbered and transformed together; one with missing
    values is a shorter series and goes alone.
    """
    found = []
    names = columns[:MAX_COLUMNS]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, points long, periodicity double")
    values = {c: quoted(c).cast("double") for c in names}
    values = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
    ).first()
    whole = [i for i in range(len(names)) if row[f"n{i}"] == row["rows"]]
    for group in [whole, *([i] for i in range(len(names)) if i not in whole)]:
        if not group or row[f"n{group[0]}"] < MIN_POINTS:
            continue
        n = row[f"n{group[0]}"]
        off = [(values[names[i]] - F.lit(row[f"m{i}"])).alias(f"v{i}") for i in group]
        series = df.select(quoted(order).alias("_order"), *off).where(F.col(f"v{group[0]}").isNotNull())
        points = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("re")) for i in group])
        numbered = number_rows(series, "_order", "pos").select("pos", F.inline(points)).select("c", "pos", "re", F.lit(0.0).alias("im"))
        strength = _strength(transform_series(numbered, n, limit), n)
        named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("c") + 1)
        found.append(strength.select(named.alias("column"), F.lit(n).cast("long").alias("points"), "periodicity"))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, points long, periodicity double")
    return reduce(DataFrame.unionByName, found)


def table_periodicity(df: DataFrame, columns: list[str], order: str, limit: int | None = None) -> DataFrame:
    """The mean over the analysed columns, 0 without any."""
    return column_periodicity(df, columns, order, limit).agg(
        F.coalesce(F.avg("periodicity"), F.lit(0.0)).alias("periodicity")
    )
