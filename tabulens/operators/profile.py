"""Column profiles from the value histogram.

``facts`` is one grouped aggregate; each public function selects from it, and Catalyst drops what is not
asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.scoring import ratio
from tabulens.operators.histogram import data_columns, is_digest, judged, unpivoted
from tabulens.operators.typescores import (
    CATEGORICAL_MEAN_LENGTH,
    CATEGORICAL_RATIO,
    is_categorical,
    type_scores,
)

# Thresholds of id-likeness, of column types, and the number of top values.
ID_DISTINCT_RATIO = 0.9
ID_MEAN_LENGTH = 32
ID_DIGIT_SHARE = 0.5
ID_ALNUM_SHARE = 0.7
TYPE_SHARE = 0.9
TOP_VALUES = 10


def facts(hist: DataFrame, scope: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """One row per scope and column with all counts that the profile needs, and any ``more`` aggregates."""
    cnt, value = F.col("cnt"), F.col("value")
    present, filled, numeric, datetime = value.isNotNull(), F.col("filled"), F.col("numeric"), F.col("datetime")

    def total(condition: Column, what: Column = cnt) -> Column:
        return F.coalesce(F.sum(F.when(condition, what)), F.lit(0))

    return (
        judged(hist)
        .groupBy(*scope, "column")
        .agg(
            F.sum(cnt).alias("rows"),
            total(present).alias("non_null"),
            F.count(value).alias("distinct"),
            F.sum(F.when(present, cnt * F.log(cnt.cast("double")))).alias("count_log_sum"),
            total(present, cnt * F.col("size")).alias("length_sum"),
            total(F.col("digits")).alias("digit_values"),
            total(F.col("alnum")).alias("alnum_values"),
            total(F.col("castable")).alias("castable_values"),
            total(numeric & present).alias("numeric_values"),
            total(present & (datetime | ~filled)).alias("datetime_values"),
            total(filled).alias("filled"),
            total(filled & numeric).alias("filled_numeric"),
            total(filled & ~numeric & datetime).alias("filled_datetime"),
            total(filled, cnt * F.col("text_size")).alias("filled_length"),
            F.count(F.when(filled, 1)).alias("filled_distinct"),
            F.count(F.when(filled & ~F.col("padded"), 1)).alias("unpadded_distinct"),
            *more,
        )
    )


def _exact_text_distinct(hist: DataFrame, fact: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Replace ``filled_distinct`` by the exact count of trimmed values where it decides anything.

    Padded values may coincide with others once trimmed. The counts of all values and of unpadded values
    bound the exact one from both sides; only columns whose categorical flag lies between the bounds are
    counted again, which is none in most data, and an empty side then ends the join at run time.
    """
    keys = [*scope, "column"]
    n = F.col("filled")
    open_question = (
        (ratio(F.col("filled_distinct"), n) >= CATEGORICAL_RATIO)
        & (ratio(F.col("unpadded_distinct"), n) < CATEGORICAL_RATIO)
        & (F.col("unpadded_distinct") < F.col("filled_distinct"))
        & (ratio(F.col("filled_length"), n) < CATEGORICAL_MEAN_LENGTH)
    )
    # One row per column without a scope; within scopes the groups are as small as the scopes. Joining on the
    # column alone would otherwise send all values of a column to one task.
    asked = fact.where(open_question).select(*keys)
    recount = (
        judged(hist)
        .where(F.col("filled"))
        .join(asked if scope else F.broadcast(asked), keys, "left_semi")
        .select(*keys, "text")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("text_distinct"))
    )
    return (
        fact.join(recount, keys, "left")
        .withColumn("filled_distinct", F.coalesce("text_distinct", "filled_distinct"))
        .drop("text_distinct")
    )


def _type_scores() -> Column:
    n = F.col("filled")
    flag = is_categorical(n, F.col("filled_distinct"), ratio(F.col("filled_length"), n))
    return type_scores(n, F.col("filled_numeric"), F.col("filled_datetime"), flag)


def _null_rate() -> Column:
    return F.round(1.0 - ratio(F.col("non_null"), F.col("rows")), 6)


def _unique_ratio() -> Column:
    return ratio(F.col("distinct"), F.col("non_null"))


def _entropy() -> Column:
    n = F.col("non_null")
    spread = F.log(n.cast("double")) - F.try_divide(F.col("count_log_sum"), n.cast("double"))
    # Rounding noise of a constant column must not show as a negative zero.
    return F.when(n > 0, F.round(F.greatest(spread, F.lit(0.0)), 6)).otherwise(0.0)


def _mean_length() -> Column:
    return ratio(F.col("length_sum"), F.col("non_null"))


def _id_like() -> Column:
    n = F.col("non_null")
    return (
        (n > 0)
        & (_unique_ratio() > ID_DISTINCT_RATIO)
        & (_mean_length() <= ID_MEAN_LENGTH)
        & ((ratio(F.col("digit_values"), n) > ID_DIGIT_SHARE) | (ratio(F.col("alnum_values"), n) > ID_ALNUM_SHARE))
    )


def _column_type() -> Column:
    """Type after numeric coercion: a column with any castable value holds numbers only from then on."""
    n = F.col("non_null")
    return (
        F.when(n == 0, "empty")
        .when((F.col("castable_values") > 0) | (ratio(F.col("numeric_values"), n) > TYPE_SHARE), "numeric")
        .when(ratio(F.col("datetime_values"), n) > TYPE_SHARE, "datetime")
        .when(_unique_ratio() < CATEGORICAL_RATIO, "categorical")
        .otherwise("text")
    )


def null_rates(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(*scope, "column", _null_rate().alias("null_rate"))


def distinct_counts(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(
        *scope, "column", F.col("distinct").alias("unique_count"), F.round(_unique_ratio(), 6).alias("unique_ratio")
    )


def column_type_scores(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    exact = _exact_text_distinct(hist, facts(hist, scope), scope)
    return exact.select(*scope, "column", _type_scores().alias("type_scores"))


def entropies(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(*scope, "column", _entropy().alias("entropy"))


def ranked_values(hist: DataFrame, scope: tuple[str, ...] = (), limit: int = TOP_VALUES) -> DataFrame:
    """``scope..., column, rank, value, cnt, first_idx``: most common first, then first seen.

    The rank limit is applied per task before the exchange, so a column sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy(*scope, "column").orderBy(F.desc("cnt"), F.asc("first_idx"))
    return (
        hist.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(*scope, "column", "rank", "value", "cnt", "first_idx")
    )


def restore_values(
    ranked: DataFrame, source: DataFrame, columns: list[str], scope: tuple[str, ...] = (), order: str = "_row_idx"
) -> DataFrame:
    """Put the texts of long values back, from the row each was first seen in.

    Only those rows are read out of the table: without a scope they are at most ``limit`` per column and are
    broadcast. Where no value is long, the empty side ends the join before the table is read.
    """
    wanted = ranked.where(is_digest(F.col("value"))).select(*scope, "column", F.col("first_idx").alias(order))
    rows = wanted.select(*scope, order).distinct()
    keys = [*scope, order]
    found = source.join(rows if scope else F.broadcast(rows), keys, "left_semi")
    cells = unpivoted(found, columns, keys).withColumnRenamed("value", "_text")
    texts = cells.join(wanted if scope else F.broadcast(wanted), [*keys, "column"], "left_semi")
    return (
        ranked.join(texts.withColumnRenamed(order, "first_idx"), [*scope, "column", "first_idx"], "left")
        .withColumn("value", F.when(is_digest(F.col("value")), F.col("_text")).otherwise(F.col("value")))
        .select(*ranked.columns)
    )


def top_values(ranked: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``scope..., column, top_samples`` from ranked values."""
    keys = [*scope, "column"]
    return (
        ranked.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
        .select(*keys, F.transform("ranked", lambda v: v.getField("value")).alias("top_samples"))
    )


def id_likeness(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(*scope, "column", _id_like().alias("is_id_like"))


def mean_lengths(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(*scope, "column", F.round(_mean_length(), 3).alias("avg_length"))


def column_types(hist: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return facts(hist, scope).select(*scope, "column", _column_type().alias("column_type"))


def column_profile(
    hist: DataFrame,
    scope: tuple[str, ...] = (),
    limit: int = TOP_VALUES,
    source: DataFrame | None = None,
    columns: list[str] | None = None,
    order: str = "_row_idx",
) -> DataFrame:
    """The full profile, one row per scope and column.

    ``source`` is the table of the histogram and lets top values of long texts be shown as they are; without it
    they are shown by their digest.
    """
    keys = [*scope, "column"]
    exact = _exact_text_distinct(hist, facts(hist, scope), scope)
    ranked = ranked_values(hist, scope, limit)
    if source is not None:
        ranked = restore_values(ranked, source, columns or data_columns(source, exclude=(*scope, order)), scope, order)
    return from_facts(exact.join(top_values(ranked, scope), keys, "left"), keys)


def from_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The profile of facts that have their ``top_samples``."""
    return facts.select(
        *keys,
        F.col("rows"),
        _null_rate().alias("null_rate"),
        F.col("distinct").alias("unique_count"),
        F.round(_unique_ratio(), 6).alias("unique_ratio"),
        _type_scores().alias("type_scores"),
        _entropy().alias("entropy"),
        F.coalesce("top_samples", F.array().cast("array<string>")).alias("top_samples"),
        _id_like().alias("is_id_like"),
        F.round(_mean_length(), 3).alias("avg_length"),
        _column_type().alias("column_type"),
    )
