"""Facts about the columns of a typed table: the shared input of perception and of the schema graph.

The table is read by a handful of aggregates, never column by column. What leaves the executors is one row per
column, which is metadata of a size set by the schema; scores are then computed from those rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.predicates import is_datetime
from tabulens.functions.scoring import finite
from tabulens.operators.histogram import LONG_VALUE, digest_key

# Sample sizes of the value samples, fewest values for distribution statistics, outlier limit.
VALUE_SAMPLE = 20
TEXT_SAMPLE = 50
TYPE_SAMPLE = 10
MIN_VALUES = 10
OUTLIER_Z = 3.0
HEAD_ROWS = 4096
HEAD_GROWTH = 1024

_DTYPES = {
    T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8", T.DoubleType: "float64",
    T.FloatType: "float32", T.BooleanType: "bool", T.TimestampType: "datetime64[ns]",
    T.TimestampNTZType: "datetime64[ns]", T.DateType: "datetime64[ns]",
}

FACT_SCHEMA = (
    "table string, ordinal int, column string, data_type string, is_numeric boolean, is_numberlike boolean, "
    "is_text boolean, is_time boolean, rows long, non_null long, mean double, std double, skew double, "
    "kurt double, distinct long, sample_n long, sample_dates long, type_n long, type_dates long, "
    "text_n long, text_length double, outliers long"
)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_fields(df: DataFrame, exclude: Iterable[str] = ()) -> list[T.StructField]:
    return [f for f in df.schema.fields if not f.name.startswith("_") and f.name not in exclude]


def describe_schema(df: DataFrame, table: str, exclude: Iterable[str] = ()) -> list[dict]:
    """What the schema alone says about every column."""
    described = []
    for ordinal, f in enumerate(data_fields(df, exclude)):
        numeric = isinstance(f.dataType, T.NumericType)
        described.append(
            {
                "table": table,
                "ordinal": ordinal,
                "column": f.name,
                "data_type": _DTYPES.get(type(f.dataType), "object"),
                "is_numeric": numeric,
                "is_numberlike": numeric or isinstance(f.dataType, T.BooleanType),
                "is_text": isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)),
                "is_time": isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)),
            }
        )
    return described


def catalogue(df: DataFrame, table: str, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per column from the schema alone; no data is read."""
    names = "table string, ordinal int, column string, data_type string, is_numeric boolean, is_numberlike boolean, is_text boolean, is_time boolean"
    return df.sparkSession.createDataFrame(describe_schema(df, table, exclude), names)


def present(field: T.StructField) -> Column:
    """The value, with "not a number" read as missing."""
    c = quoted(field.name)
    return F.when(~F.isnan(c), c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c


def _as_rows(wide: DataFrame, names: list[str], measures: dict[str, str]) -> DataFrame:
    """One aggregate row with columns ``measure_i`` as one row per column name."""
    items = [
        F.struct(
            F.lit(name).alias("column"),
            *[(F.col(f"{m}_{i}") if f"{m}_{i}" in wide.columns else F.lit(None)).cast(t).alias(m) for m, t in measures.items()],
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*items)))


def cell_stats(df: DataFrame, exclude: Iterable[str] = (), moments: bool = True) -> DataFrame:
    """``column, rows, non_null, mean, std, skew, kurt`` by one aggregate over the table.

    Skewness and excess kurtosis are those of the population and null for constant columns.
    """
    fields = data_fields(df, exclude)
    aggregates = []
    for i, f in enumerate(fields):
        aggregates += [F.count(F.lit(1)).alias(f"rows_{i}"), F.count(present(f)).alias(f"non_null_{i}")]
        if moments and isinstance(f.dataType, T.NumericType):
            x = finite(quoted(f.name))
            aggregates += [
                F.avg(x).alias(f"mean_{i}"), F.stddev_pop(x).alias(f"std_{i}"),
                F.skewness(x).alias(f"skew_{i}"), F.kurtosis(x).alias(f"kurt_{i}"),
            ]
    measures = {"rows": "long", "non_null": "long"}
    if moments:
        measures |= {"mean": "double", "std": "double", "skew": "double", "kurt": "double"}
    return _as_rows(df.agg(*aggregates), [f.name for f in fields], measures)


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "long"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"
    return "string"


def _unpivot_family(df: DataFrame, fields: list[T.StructField], family: str, ids: tuple[str, ...] = ()) -> DataFrame:
    columns = [
        (present(f).cast("int") if isinstance(f.dataType, T.BooleanType) else present(f)).cast(family).alias(f.name)
        for f in fields
    ]
    names = ["`" + f.name.replace("`", "``") + "`" for f in fields]
    return df.select(*ids, *columns).unpivot(list(ids), names, "column", "value").where(F.col("value").isNotNull())


def approximate_distinct_stats(df: DataFrame, rsd: float, exclude: Iterable[str] = ()) -> DataFrame:
    """``column, distinct`` by sketches: one pass without an exchange of values, within ``rsd`` of the truth."""
    fields = data_fields(df, exclude)
    wide = df.agg(*[F.approx_count_distinct(present(f), rsd).alias(f"distinct_{i}") for i, f in enumerate(fields)])
    return _as_rows(wide, [f.name for f in fields], {"distinct": "long"})


def distinct_stats(df: DataFrame, exclude: Iterable[str] = (), only: Iterable[str] | None = None) -> DataFrame:
    """``column, distinct``: exact counts, values grouped in their own type rather than as text.

    Columns of one type family share an exchange; repeated values collapse before it.
    """
    wanted = None if only is None else set(only)
    fields = [f for f in data_fields(df, exclude) if wanted is None or f.name in wanted]
    counts = []
    for family in ("long", "double", "timestamp_ntz", "string"):
        members = [f for f in fields if _family(f.dataType) == family]
        if members:
            cells = _unpivot_family(df, members, family)
            if family == "string":  # long texts travel as digests
                is_long = F.octet_length("value") > LONG_VALUE
                cells = cells.withColumn("value", F.when(is_long, digest_key(F.col("value"))).otherwise(F.col("value")))
            values = cells.groupBy("column", "value").agg(F.lit(1).alias("one"))
            counts.append(values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, distinct long")
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


def head_values(
    df: DataFrame, order: str, n: int, exclude: Iterable[str] = (), only: Iterable[str] | None = None
) -> DataFrame:
    """``column, rank, value``: the first ``n`` non-null values of every column, as strings.

    Instead of ranking the whole table, a prefix of rows is probed and grown until it holds enough values of
    every column; a sparse column goes on alone. ``order`` is an integer column, so prefixes are range
    filters that reach the scan. Rows without an order come last, whatever the size of the table.
    """
    wanted = None if only is None else set(only)
    fields = [f for f in data_fields(df, (*exclude, order)) if wanted is None or f.name in wanted]
    if order not in exclude and not order.startswith("_") and (wanted is None or order in wanted):
        fields = [f for f in data_fields(df, exclude) if wanted is None or f.name in wanted]
    key = quoted(order)
    low, high = df.agg(F.min(key), F.max(key)).first()
    parts, open_fields = [], fields
    width = max(HEAD_ROWS, 4 * n)
    while open_fields:
        last = low is None or low + width > high
        prefix = df if last else df.where(key < F.lit(low + width))
        if last:
            ready = open_fields
        else:
            found = prefix.agg(*[F.count(present(f)).alias(f"c{i}") for i, f in enumerate(open_fields)]).first()
            ready = [f for i, f in enumerate(open_fields) if found[i] >= n]
        if ready:
            columns = [present(f).cast("string").alias(f.name) for f in ready]
            names = ["`" + f.name.replace("`", "``") + "`" for f in ready]
            parts.append(
                prefix.select(key.alias("_order"), *columns)
                .unpivot(["_order"], names, "column", "value")
                .where(F.col("value").isNotNull())
            )
        open_fields = [f for f in open_fields if f not in ready]
        width *= HEAD_GROWTH
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string")
    values = parts[0]
    for more in parts[1:]:
        values = values.unionByName(more)
    first = Window.partitionBy("column").orderBy(F.col("_order").asc_nulls_last())
    return (
        values.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).select("column", "rank", "value")
    )


def head_stats(heads: DataFrame) -> DataFrame:
    """How many of the first values look like dates, and how long they are on average."""
    rank, date = F.col("rank"), is_datetime(F.col("value"))

    def count(limit: int, condition: Column) -> Column:
        return F.count(F.when((rank <= limit) & condition, 1))

    everything = F.lit(True)
    return heads.groupBy("column").agg(
        count(VALUE_SAMPLE, everything).alias("sample_n"),
        count(VALUE_SAMPLE, date).alias("sample_dates"),
        count(TYPE_SAMPLE, everything).alias("type_n"),
        count(TYPE_SAMPLE, date).alias("type_dates"),
        count(TEXT_SAMPLE, everything).alias("text_n"),
        F.avg(F.when(rank <= TEXT_SAMPLE, F.length("value"))).alias("text_length"),
    )


def outlier_counts(df: DataFrame, stats: Iterable, limit: float = OUTLIER_Z) -> DataFrame:
    """``column, outliers``: values more than ``limit`` deviations from the mean, by one aggregate."""
    usable = [r for r in stats if r["std"] is not None and r["std"] > 0]
    if not usable:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    wide = df.agg(
        *[
            F.count(F.when(F.abs(finite(quoted(r["column"])) - r["mean"]) / r["std"] > limit, 1)).alias(f"outliers_{i}")
            for i, r in enumerate(usable)
        ]
    )
    return _as_rows(wide, [r["column"] for r in usable], {"outliers": "long"})


def table_facts(
    df: DataFrame, table: str, order: str, exclude: Iterable[str] = (), outliers: bool = True, approximate: float | None = None,
    heads: DataFrame | None = None,
) -> DataFrame:
    """All facts of one table, one row per column, as a small local DataFrame.

    Tables of a schema can be united afterwards: every score groups by ``table``. Distinct counts are exact
    unless ``approximate`` gives a relative error to accept. ``heads`` are the first ``TEXT_SAMPLE`` values of every column,
    where they are known already.
    """
    rows = {r["column"]: dict(r) for r in describe_schema(df, table, exclude)}
    if rows:
        stats = cell_stats(df, exclude).collect()
        counted = distinct_stats(df, exclude) if approximate is None else approximate_distinct_stats(df, approximate, exclude)
        frames = [stats, counted.collect()]
        heads = head_values(df, order, TEXT_SAMPLE, exclude) if heads is None else heads
        frames.append(head_stats(heads).collect())
        if outliers:
            frames.append(outlier_counts(df, stats).collect())
        for frame in frames:
            for r in frame:
                rows[r["column"]].update(r.asDict())
    names = [f.split()[0] for f in FACT_SCHEMA.split(", ")]
    counts = ("distinct", "sample_n", "sample_dates", "type_n", "type_dates", "text_n", "outliers", "rows", "non_null")
    data = [
        tuple(r.get(n) if r.get(n) is not None or n not in counts else 0 for n in names)
        for r in sorted(rows.values(), key=lambda r: r["ordinal"])
    ]
    return df.sparkSession.createDataFrame(data, FACT_SCHEMA)
