"""Plain delimited scan with inferred types: all strings first, then numbers where values are numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.predicates import null_tokens_to_null
from tabulens.operators.anomaly import coerce_numeric
from tabulens.operators.tablefacts import quoted


def clean_nulls(df: DataFrame) -> DataFrame:
    """Null tokens of all string columns become null."""
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: null_tokens_to_null(quoted(c)) for c in strings})


def read_typed(
    spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None, mode: str = "share", min_share: float = 1.0
) -> DataFrame:
    """Read files of one known format; a column becomes numeric if ``min_share`` of its values are numbers.

    Spark's own inference would read the files once more and stop at a sample; here one aggregate over the
    strings decides. Without ``columns`` the header names them.
    """
    raw = spark.read.option("sep", sep).option("escape", '"').csv(path, header=True)
    if columns:
        raw = raw.select(*[F.col(f"`{c}`") for c in columns])
    return coerce_numeric(clean_nulls(raw), mode=mode, min_share=min_share)
