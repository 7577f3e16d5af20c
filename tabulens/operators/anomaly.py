"""Soft marking of anomalous rows: every row keeps its place and gets a score.

Two scopes. ``global``: statistics of the whole table come from one aggregate whose single row is fitted into
a narrow projection, so scoring moves no data. ``chunk``: statistics are windows over ``_chunk_id``; a chunk
is bounded by ``chunk_rows``, and all windows share one exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.predicates import to_number
from tabulens.functions.scoring import abs_zscore, finite, min_max
from tabulens.operators.histogram import data_columns

# Weights of the ensemble and of its fallback, the text length of a missing cell.
MISSING_WEIGHT = 0.30
LENGTH_WEIGHT = 0.6
LENGTH_MISSING_WEIGHT = 0.4
MISSING_TEXT_LENGTH = 3
CHUNK_KEY = "_chunk_id"


@dataclass(frozen=True)
class Scope:
    """How statistics of a scope reach its rows."""

    chunked: bool = False
    keys: tuple[str, ...] = ()

    def attach(self, df: DataFrame, stats: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        """Make each aggregate available as an expression on the rows of ``df``."""
        if self.chunked:
            window = Window.partitionBy(*self.keys, CHUNK_KEY)
            added = df.withColumns({f"_stat_{k}": v.over(window) for k, v in stats.items()})
            return added, {k: F.col(f"_stat_{k}") for k in stats}
        row = df.agg(*[v.alias(k) for k, v in stats.items()]).first()
        return df, {k: F.lit(row[k]) for k in stats}


GLOBAL = Scope()
CHUNK = Scope(chunked=True)


def scope_of(name: str, keys: tuple[str, ...] = ()) -> Scope:
    if name not in ("global", "chunk"):
        raise ValueError(f"unknown scope {name!r}")
    return Scope(chunked=name == "chunk", keys=keys)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def coerce_numeric(
    df: DataFrame, columns: list[str] | None = None, mode: str = "any", min_share: float = 0.5
) -> DataFrame:
    """Replace string columns by numbers; ``any``: as soon as one value is a number.

    ``share``: only where at least ``min_share`` of the non-null values are. One aggregate decides for all.
    """
    columns = columns or [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]
    if not columns:
        return df
    row = df.agg(
        *[F.count(to_number(_quoted(c))).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count(_quoted(c)).alias(f"all{i}") for i, c in enumerate(columns)],
    ).first()

    def is_number(i: int) -> bool:
        found, present = row[f"n{i}"], row[f"all{i}"]
        return found > 0 and (mode == "any" or found >= min_share * present)

    return df.withColumns({c: to_number(_quoted(c)) for i, c in enumerate(columns) if is_number(i)})


def _is_missing(cell: Column) -> Column:
    return cell.isNull() | (cell.cast("string") == "")


def missing_ratio(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Share of null or empty cells of a row."""
    columns = columns or data_columns(df)
    missing = sum((F.when(_is_missing(_quoted(c)), 1).otherwise(0) for c in columns), F.lit(0))
    return missing / F.lit(len(columns))


def text_length(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Total text length of a row; a missing cell counts as ``nan``."""
    columns = columns or data_columns(df)
    sizes = (F.coalesce(F.length(_quoted(c).cast("string")), F.lit(MISSING_TEXT_LENGTH)) for c in columns)
    return sum(sizes, F.lit(0)).cast("double")


def _numbers(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Value of every column as a number; strings are coerced."""
    types = dict(df.dtypes)

    def number(c: str) -> Column:
        return to_number(_quoted(c)) if types[c] == "string" else _quoted(c).cast("double")

    return {c: number(c) for c in columns}


def score_rows(
    df: DataFrame,
    scope: Scope = GLOBAL,
    columns: list[str] | None = None,
    iforest_score: str | None = None,
    missing_weight: float = MISSING_WEIGHT,
) -> DataFrame:
    """Add ``_missing_ratio, _z, _mean_z, _anomaly_score`` to every row.

    A string column counts as numeric within a scope as soon as one of its values there is a number; its other
    cells then count as missing. Without any numeric column the row's text length is scored instead.
    ``iforest_score`` names a column that holds an isolation-forest score and joins the ensemble.
    """
    columns = columns or data_columns(df, exclude=scope.keys)
    types = dict(df.dtypes)
    numberlike = [
        c for c in columns
        if types[c] in ("string", "double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal")
    ]
    numbers = _numbers(df, numberlike)
    at = {c: i for i, c in enumerate(columns)}

    # Pass 1: which columns are numeric here, their mean and deviation, the spread of text lengths.
    stats: dict[str, Column] = {}
    for c in numberlike:
        i = at[c]
        if types[c] == "string":
            stats[f"n{i}"] = F.count(numbers[c])
        stats[f"mean{i}"] = F.avg(finite(numbers[c]))
        stats[f"std{i}"] = F.stddev_pop(finite(numbers[c]))
    length = text_length(df, columns)
    stats["length_mean"], stats["length_std"] = F.avg(length), F.stddev_pop(length)
    rows, stat = scope.attach(df, stats)

    def is_numeric(c: str) -> Column:
        if c not in numberlike:
            return F.lit(False)
        return (stat[f"n{at[c]}"] > 0) if types[c] == "string" else F.lit(True)

    z, missing = {}, F.lit(0)
    for c in columns:
        gone = _is_missing(_quoted(c))
        if c in numberlike:
            z[c] = F.when(
                is_numeric(c), abs_zscore(finite(numbers[c]), stat[f"mean{at[c]}"], stat[f"std{at[c]}"])
            )
            gone = F.when(is_numeric(c), numbers[c].isNull()).otherwise(gone)
        missing = missing + F.when(gone, 1).otherwise(0)
    n_numeric = sum((F.when(is_numeric(c), 1).otherwise(0) for c in columns), F.lit(0))
    total_z = sum((F.coalesce(v, F.lit(0.0)) for v in z.values()), F.lit(0.0))
    z_map = F.map_filter(
        F.create_map(*[x for c, v in z.items() for x in (F.lit(c), v)]) if z else F.create_map().cast("map<string,double>"),
        lambda _, v: v.isNotNull(),
    )
    length_z = abs_zscore(length, stat["length_mean"], stat["length_std"])
    scored = rows.withColumns(
        {
            "_missing_ratio": missing / F.lit(len(columns)),
            "_z": z_map,
            "_has_numbers": n_numeric > 0,
            "_mean_z": F.when(n_numeric > 0, total_z / n_numeric).otherwise(length_z),
        }
    )

    # Pass 2: the range of the mean z (and of the forest score) within the scope.
    ranges = {"z_low": F.min("_mean_z"), "z_high": F.max("_mean_z")}
    if iforest_score:
        ranges |= {"iso_low": F.min(iforest_score), "iso_high": F.max(iforest_score)}
    scored, span = scope.attach(scored, ranges)
    z_norm = min_max(F.col("_mean_z"), span["z_low"], span["z_high"])
    gone = F.col("_missing_ratio")
    ensemble = (1.0 - missing_weight) * z_norm + missing_weight * gone
    if iforest_score:
        half = (1.0 - missing_weight) / 2
        iso = F.col(iforest_score)
        iso_norm = min_max(iso, span["iso_low"].cast("double"), span["iso_high"].cast("double"))
        # A scope too small for a forest has no score and keeps the plain ensemble.
        ensemble = F.when(iso.isNull(), ensemble).otherwise(half * z_norm + half * iso_norm + missing_weight * gone)
    by_length = LENGTH_WEIGHT * z_norm + LENGTH_MISSING_WEIGHT * gone
    marked = scored.withColumn(
        "_anomaly_score", F.when(F.col("_has_numbers"), ensemble).otherwise(by_length)
    )
    return marked.drop("_has_numbers", *[c for c in marked.columns if c.startswith("_stat_")])


def mark_anomalies(df: DataFrame, scope: Scope = GLOBAL, **options) -> DataFrame:
    """The table with ``_anomaly_score`` appended; no row is dropped."""
    return score_rows(df, scope, **options).drop("_missing_ratio", "_z", "_mean_z")


def methods_used(iforest: bool) -> list[str]:
    return ["z_score", "isolation_forest"] if iforest else ["z_score"]
