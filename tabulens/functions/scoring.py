"""Small numeric expressions shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard of the min-max scale, slope and centre of the confidence curve.
SCALE_GUARD = 1e-9
SIGMOID_SLOPE = 3.0
SIGMOID_CENTRE = 0.3


def sigmoid(x: Column, slope: float = SIGMOID_SLOPE, centre: float = SIGMOID_CENTRE) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - centre)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + SCALE_GUARD)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def finite(x: Column) -> Column:
    """The value, or null when it is infinite or not a number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def abs_zscore(x: Column, mean: Column, std: Column) -> Column:
    """``|x - mean| / std``; 0 for missing values and for constant columns."""
    return F.when(x.isNotNull() & (std > 0), F.abs(x - mean) / std).otherwise(F.lit(0.0))
