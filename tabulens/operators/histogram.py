"""The value histogram: the shared intermediate of all column profiles.

One unpivot and one grouped count. Equal values collapse on the map side, so a value that fills a third of
all rows costs one row per task, and every predicate on texts is evaluated once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.predicates import (
    is_all_digits,
    is_alphanumeric,
    is_datetime,
    is_datetime_text,
    is_numeric,
    strip,
    to_number,
)

# Values of more bytes than this are grouped by their digest. The mark keeps digests apart from values.
LONG_VALUE = 256
DIGEST_MARK = "\x01sha256:"


def data_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns of the data; names that begin with an underscore belong to the engine."""
    return [c for c in df.columns if not c.startswith("_") and c not in exclude]


def unpivoted(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """``ids..., column, value`` with values as strings; nulls are kept."""
    return df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(
        ids, [f"`{c}`" for c in columns], "column", "value"
    )


def digest_key(value: Column) -> Column:
    """Stands for a long value in groupings: the digests of its trimmed and of its full text."""
    return F.concat(F.lit(DIGEST_MARK), F.sha2(strip(value), 256), F.sha2(value, 256))


def is_digest(key: Column) -> Column:
    return key.startswith(DIGEST_MARK)


def _long_flags(value: Column) -> Column:
    """What is asked about a long value, as bits, since its text does not travel."""
    text = strip(value)
    answers = (is_numeric(text), is_datetime(text), is_all_digits(value), is_alphanumeric(value), to_number(value).isNotNull())
    return sum((F.when(answer, 1 << bit).otherwise(0) for bit, answer in enumerate(answers)), F.lit(0))


def value_histogram(
    df: DataFrame, columns: list[str] | None = None, scope: tuple[str, ...] = (), order: str | None = "_row_idx"
) -> DataFrame:
    """``scope..., column, value, cnt, first_idx``; the null value is a group of its own.

    Values of more than ``LONG_VALUE`` bytes are grouped by digest, so that long texts are read where they lie
    and never shuffled; ``long_size, long_text_size, long_flags`` carry what is asked about them, and
    ``profile.restore_values`` fetches the few that are shown.
    """
    columns = columns or data_columns(df, exclude=(*scope, order or ""))
    ids = [*scope, *([order] if order else [])]
    first = [F.min(order).alias("first_idx")] if order else []
    value = F.col("value")
    is_long = F.octet_length(value) > LONG_VALUE
    return (
        unpivoted(df, columns, ids)
        .select(
            *ids,
            "column",
            F.when(is_long, digest_key(value)).otherwise(value).alias("value"),
            F.when(is_long, F.length(value)).alias("long_size"),
            F.when(is_long, F.length(strip(value))).alias("long_text_size"),
            F.when(is_long, _long_flags(value)).alias("long_flags"),
        )
        .groupBy(*scope, "column", "value")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            *first,
            *[F.max(c).alias(c) for c in ("long_size", "long_text_size", "long_flags")],
        )
    )


def judged(hist: DataFrame) -> DataFrame:
    """The histogram with everything that is decided per distinct value."""
    value, text = F.col("value"), F.col("text")
    is_long = F.col("long_size").isNotNull()

    def answer(bit: int, short: Column) -> Column:
        return F.when(is_long, F.col("long_flags").bitwiseAND(1 << bit) > 0).otherwise(short)

    return (
        hist.withColumn("text", F.when(is_long, F.substring(value, 1, len(DIGEST_MARK) + 64)).otherwise(strip(value)))
        .withColumn("size", F.coalesce("long_size", F.length(value)))
        .withColumn("text_size", F.coalesce("long_text_size", F.length(text)))
        .withColumn("filled", F.col("text_size") > 0)
        .withColumn("padded", F.col("text_size") < F.col("size"))
        .withColumn("numeric", answer(0, is_numeric(text)))
        .withColumn("datetime", answer(1, is_datetime_text(text)))
        .withColumn("digits", answer(2, is_all_digits(value)))
        .withColumn("alnum", answer(3, is_alphanumeric(value)))
        .withColumn("castable", answer(4, to_number(value).isNotNull()))
    )
