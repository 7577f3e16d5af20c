"""Profile states: what the profile of a chunk leaves behind, so that files and tables are profiled without their rows.

A state has two tables. Facts are sums, which add up, and sketches of the distinct values, which unite. Counters are the
most common values of a chunk with their counts; what a chunk does not list occurs in it no more often than the first
value that it left out, and these limits add up too. A merged state is a state: chunks merge into files, files into
tables, in any order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.operators.profile import TOP_VALUES, facts, from_facts, ranked_values, top_values
from tabulens.sources.workdir import stored

SUMS = (
    "rows", "non_null", "length_sum", "digit_values", "alnum_values", "castable_values", "numeric_values", "datetime_values", "filled",
    "filled_numeric", "filled_datetime", "filled_length",
)
SKETCHES = {"distinct": "value", "filled_distinct": "text"}
#: Values that a state keeps of each column, and the buckets of a sketch (a power of two): its error is about 0.8 %.
COUNTERS, SKETCH = 100, 14


class ProfileState(NamedTuple):
    facts: DataFrame
    counters: DataFrame


def _cut(ranked: DataFrame, scope: tuple[str, ...], counters: int) -> DataFrame:
    """The first ``counters`` values; the next one is left as a row without a value, whose count is the limit of all others."""
    kept = F.col("rank") <= counters
    return ranked.select(
        *scope, "column", F.when(kept, F.col("value")).alias("value"), F.when(kept, F.col("cnt")).alias("cnt"), F.when(kept, F.col("first_idx")).alias("first_idx"),
        F.when(~kept, F.col("cnt")).alias("missed"),
    )


def profile_state(hist: DataFrame, scope: tuple[str, ...] = (), counters: int = COUNTERS, sketch: int = SKETCH) -> ProfileState:
    """The state of a value histogram by ``scope``."""
    united = [
        F.hll_sketch_agg(F.when(F.col("filled"), F.col("text")) if source == "text" else F.col(source), sketch).alias(f"{name}_sketch")
        for name, source in SKETCHES.items()
    ]
    found = facts(hist, scope, *united).select(*scope, "column", *SUMS, *[f"{name}_sketch" for name in SKETCHES])
    return ProfileState(found, _cut(ranked_values(hist, scope, counters + 1), scope, counters))


def stored_state(state: ProfileState, purpose: str = "state") -> ProfileState:
    """The state in the shared folder; it can be read there again and merged with others."""
    return ProfileState(*(stored(df, f"{purpose}-{name}") for name, df in zip(state._fields, state)))


def merged(state: ProfileState, scope: tuple[str, ...] = (), counters: int = COUNTERS) -> ProfileState:
    """The state by a wider ``scope``, of which each one's columns are among the state's own."""
    keys = [*scope, "column"]
    sums = [F.sum(c).alias(c) for c in SUMS] + [F.hll_union_agg(f"{name}_sketch").alias(f"{name}_sketch") for name in SKETCHES]
    values = state.counters.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"), F.min("first_idx").alias("first_idx"))
    limits = state.counters.where(F.col("missed").isNotNull()).groupBy(*keys).agg(F.sum("missed").alias("missed"))
    none = [F.lit(None).cast(values.schema[c].dataType).alias(c) for c in ("value", "cnt", "first_idx")]
    kept = _cut(ranked_values(values, scope, counters + 1), scope, counters)
    return ProfileState(state.facts.groupBy(*keys).agg(*sums), kept.unionByName(limits.select(*keys, *none, "missed")))


def state_profile(state: ProfileState, scope: tuple[str, ...] = (), limit: int = TOP_VALUES) -> DataFrame:
    """The profile of a state, and ``count_error``: how often a value may occur that no counter has.

    Sums, and what follows from them, are exact. Where ``count_error`` is 0, so are top values and entropy; otherwise the
    values without a counter are taken to be equally frequent. Distinct counts are those of the sketch.
    """
    keys = [*scope, "column"]
    values = state.counters.where(F.col("value").isNotNull())
    c = F.col("cnt").cast("double")
    listed = state.counters.groupBy(*keys).agg(
        F.coalesce(F.sum("missed"), F.lit(0)).alias("count_error"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("_listed"), F.count("value").alias("_values"),
        F.coalesce(F.sum(c * F.log(c)), F.lit(0.0)).alias("_log_sum"),
    )
    samples = top_values(ranked_values(values, scope, limit), scope)
    every = state.facts.join(listed, keys, "left").join(samples, keys, "left").fillna(0, ["count_error", "_listed", "_values"]).fillna(0.0, ["_log_sum"])
    every = every.withColumns({name: F.hll_sketch_estimate(f"{name}_sketch") for name in SKETCHES})
    exact = F.col("count_error") == 0
    every = every.withColumn("distinct", F.when(exact, F.col("_values")).otherwise(F.greatest("distinct", F.col("_values") + 1)))
    rest, others = (F.col("non_null") - F.col("_listed")).cast("double"), (F.col("distinct") - F.col("_values")).cast("double")
    every = every.withColumn("count_log_sum", F.col("_log_sum") + F.when(~exact & (rest > 0), rest * F.log(F.greatest(rest / others, F.lit(1.0)))).otherwise(0.0))
    return from_facts(every, keys).join(every.select(*keys, "count_error"), keys)
