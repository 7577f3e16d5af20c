"""Statistical channel: scores in [0, 1] from the facts of a table's columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.scoring import ratio
from tabulens.operators.dependencies import hierarchy_pairs
from tabulens.operators.semantic import attribute_rows
from tabulens.operators.spectrum import MIN_POINTS, table_periodicity
from tabulens.operators.tablefacts import MIN_VALUES

# Thresholds and scales of the scores.
DATE_SHARE = 0.8
CATEGORICAL_RATIO = 0.3
HIGH_CARDINALITY_RATIO = 0.8
LONG_TEXT = 50
TEXT_SCALE = 200
SKEW_SCALE = 2.0
KURTOSIS_SCALE = 5.0
ANOMALY_THRESHOLD = 0.7
OUTLIER_SCALE = 10


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def _capped(x: Column) -> Column:
    """At most 1; 0 where there was nothing to measure (``least`` alone would skip the null)."""
    return F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))


def _enough() -> Column:
    return F.col("is_numeric") & (F.col("non_null") > MIN_VALUES)


def is_low_cardinality() -> Column:
    return ratio(F.col("distinct"), F.col("rows")) < CATEGORICAL_RATIO


def numeric_density() -> Column:
    return _share(F.col("is_numeric"))


def sparsity() -> Column:
    return F.sum(F.col("rows") - F.col("non_null")) / F.sum("rows")


def temporal_pattern() -> Column:
    """Columns whose first values are dates; typed dates are by definition."""
    dates = F.when(F.col("is_time"), F.col("sample_n")).otherwise(F.col("sample_dates"))
    return _share(~F.col("is_numberlike") & (F.col("sample_n") > 0) & (dates >= DATE_SHARE * F.col("sample_n")))


def categorical_presence() -> Column:
    return _share(F.col("is_text") & is_low_cardinality())


def text_richness() -> Column:
    rich = F.col("is_text") & (F.col("text_n") > 0) & (F.col("text_length") > LONG_TEXT)
    return F.avg(F.when(rich, F.least(F.lit(1.0), F.col("text_length") / TEXT_SCALE)).otherwise(0.0))


def high_cardinality() -> Column:
    return _share(ratio(F.col("distinct"), F.col("rows")) > HIGH_CARDINALITY_RATIO)


def distribution_skewed() -> Column:
    """Constant columns have no skewness and are left out."""
    return _capped(F.avg(F.when(_enough(), F.abs("skew"))) / SKEW_SCALE)


def distribution_heavy_tail() -> Column:
    return _capped(F.avg(F.when(_enough(), F.abs("kurt"))) / KURTOSIS_SCALE)


def outlier_share() -> Column:
    return _capped(F.max(F.when(_enough(), ratio(F.col("outliers"), F.col("non_null")))) * OUTLIER_SCALE)


# What the facts alone decide; periodicity, hierarchy and row anomalies need the table once more.
FROM_FACTS = {
    "numeric_density": numeric_density,
    "sparsity": sparsity,
    "temporal_pattern": temporal_pattern,
    "categorical_presence": categorical_presence,
    "text_richness": text_richness,
    "high_cardinality": high_cardinality,
    "distribution_skewed": distribution_skewed,
    "distribution_heavy_tail": distribution_heavy_tail,
    "anomaly_presence": outlier_share,
}


def score(facts: DataFrame, attribute: str, name: str | None = None) -> DataFrame:
    """One attribute for every table of the facts."""
    return facts.groupBy("table").agg(FROM_FACTS[attribute]().alias(name or attribute))


def anomaly_share(scored: DataFrame, column: str = "_anomaly_score", threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Share of rows whose anomaly score exceeds the threshold."""
    return scored.agg(_share(F.col(column) > threshold).alias("anomaly_presence"))


def categorical_columns(facts: DataFrame, table: str) -> dict[str, int]:
    """Text columns of few distinct values, in column order, with their counts."""
    found = facts.where((F.col("table") == table) & F.col("is_text") & is_low_cardinality()).orderBy("ordinal")
    return {r["column"]: r["distinct"] for r in found.select("column", "distinct").collect()}


def hierarchy_score(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Share of column pairs in which the later column determines the earlier one."""
    pairs = hierarchy_pairs(df, list(columns))
    return pairs.agg(F.coalesce(_share(F.col("holds")), F.lit(0.0)).alias("hierarchical_structure"))


def statistical_scores(
    df: DataFrame, facts: DataFrame, table: str, order: str, scored: DataFrame | None = None
) -> DataFrame:
    """``table, attribute, score`` for all fifteen attributes of one table.

    ``scored`` is the table with ``_anomaly_score``; without it, shares of outlying values are used.
    """
    mine = facts.where(F.col("table") == table)
    first = mine.where("rows > 0").orderBy("ordinal").select("column", "rows", "is_numeric").collect()
    every = attribute_rows(df.sparkSession.createDataFrame([(table,)], "table string"), {})
    if not first:
        return every
    long_enough = first[0]["rows"] >= MIN_POINTS
    numeric = [r["column"] for r in first if r["is_numeric"]] if long_enough else []
    from_facts = {a: expr for a, expr in FROM_FACTS.items() if scored is None or a != "anomaly_presence"}
    parts = [
        attribute_rows(
            mine.groupBy("table").agg(*[expr().alias(a) for a, expr in from_facts.items()]),
            {a: F.col(a) for a in from_facts},
        ).where(F.col("attribute").isin(*from_facts))
    ]
    extra = [table_periodicity(df, numeric, order), hierarchy_score(df, categorical_columns(facts, table))]
    if scored is not None:
        extra.append(anomaly_share(scored))
    for one in extra:
        (name,) = one.columns
        parts.append(one.select(F.lit(table).alias("table"), F.lit(name).alias("attribute"), F.col(name).alias("score")))
    found = reduce(DataFrame.unionByName, parts).withColumnRenamed("score", "found").drop("table")
    return every.join(found, "attribute", "left").select("table", "attribute", F.coalesce("found", "score").alias("score"))
