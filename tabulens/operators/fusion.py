"""Fusion of both channels into labelled attributes with a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.scoring import sigmoid

# Weights of the two channels, of the maximum and of the mean, and the label threshold.
CHANNEL_WEIGHT = 0.5
MAX_WEIGHT = 0.6
MEAN_WEIGHT = 0.4
THRESHOLD = 0.15
TOP = 5
STRONG = 0.5


def fuse(
    semantic: DataFrame,
    statistical: DataFrame,
    semantic_weight: float = CHANNEL_WEIGHT,
    statistical_weight: float = CHANNEL_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``table, attribute, confidence`` with the evidence of both channels; full precision.

    An attribute known to one channel only scores 0 in the other.
    """
    left = semantic.select("table", "attribute", F.col("score").alias("semantic"))
    right = statistical.select("table", "attribute", F.col("score").alias("statistical"))
    a, b = F.col("semantic_score"), F.col("statistical_score")
    return (
        left.join(right, ["table", "attribute"], "full")
        .select(
            "table",
            "attribute",
            F.coalesce("semantic", F.lit(0.0)).alias("semantic_score"),
            F.coalesce("statistical", F.lit(0.0)).alias("statistical_score"),
        )
        .withColumn(
            "raw_fused", MAX_WEIGHT * F.greatest(a, b) + MEAN_WEIGHT * (semantic_weight * a + statistical_weight * b)
        )
        .withColumn("confidence", sigmoid(F.col("raw_fused")))
        .where(F.col("confidence") >= threshold)
        .withColumn("source", F.lit("fused"))
    )


def as_labels(fused: DataFrame) -> DataFrame:
    """The labels as they are reported: best first, rounded to four digits."""
    four = [F.round(c, 4).alias(c) for c in ("confidence", "semantic_score", "statistical_score", "raw_fused")]
    return fused.orderBy("table", F.desc("confidence"), "attribute").select("table", "attribute", *four, "source")


def top_attributes(fused: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` most confident attributes of every table; equals are ordered by name."""
    best = Window.partitionBy("table").orderBy(F.desc("confidence"), F.asc("attribute"))
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def above_threshold(fused: DataFrame, threshold: float = STRONG) -> DataFrame:
    return fused.where(F.col("confidence") >= threshold)


def attribute_of(fused: DataFrame, attribute: str) -> DataFrame:
    return fused.where(F.col("attribute") == attribute)
