"""Delimiter detection for many files in one job.

Contract of every function here: ``lines`` has ``file_id``, an ordering key ``line_no`` that need not be
contiguous, and ``line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.fields import DELIMITERS, field_count
from tabulens.functions.predicates import is_comment_line

# Lines looked at for the delimiter, and the default without any line.
SNIFF_LINES = 200
DEFAULT_DELIMITER = ","
TINY = 1e-9


def head_lines(lines: DataFrame, n: int = SNIFF_LINES) -> DataFrame:
    """The first ``n`` non-blank lines of every file, with ``row`` counting non-blank lines from 0.

    The rank filter is pushed below the exchange as a window group limit, so a file of any size sends at
    most ``n`` lines per input partition to the task that ranks it.
    """
    order = Window.partitionBy("file_id").orderBy("line_no")
    return (
        lines.where(F.col("line").rlike(r"\S"))
        .withColumn("row", F.row_number().over(order))
        .where(F.col("row") <= n)
        .withColumn("row", (F.col("row") - 1).cast("int"))
    )


def raw_preview(lines: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` lines of every file as they are, blank ones included."""
    order = Window.partitionBy("file_id").orderBy("line_no")
    return (
        lines.withColumn("row", F.row_number().over(order))
        .where(F.col("row") <= n)
        .withColumn("row", (F.col("row") - 1).cast("int"))
    )


def _with_counts(head: DataFrame, mode: str, candidates: tuple[str, ...]) -> DataFrame:
    used = ~is_comment_line(F.col("line")) if mode == "robust" else F.lit(True)
    return head.withColumns(
        {f"count_{i}": F.when(used, field_count(F.col("line"), d)) for i, d in enumerate(candidates)}
    )


def _best(mode: str, candidates: tuple[str, ...]) -> Column:
    scored = []
    for i in range(len(candidates)):
        mean, std = F.col(f"mean_{i}"), F.col(f"std_{i}")
        occurs = (mean > 1) if mode == "robust" else F.lit(True)
        scored.append(
            F.struct(
                F.when(mean.isNotNull() & occurs, 1).otherwise(0).alias("eligible"),
                ((mean + TINY) / (std + TINY)).alias("score"),
                F.lit(-i).alias("preference"),
            )
        )
    return F.array_max(F.array(*scored))


def file_heads(
    head: DataFrame, mode: str = "robust", lines: int = 0, candidates: tuple[str, ...] = DELIMITERS
) -> DataFrame:
    """One row per file: ``file_id, delimiter, delimiter_score`` and its first ``lines`` lines as ``entries``, with whether each is a comment.

    A delimiter scores mean / deviation of its field counts. ``robust`` leaves comment lines out and ignores
    delimiters that never occur unless none does; ``compat`` does neither. Both the statistics and the
    entries come from one grouped aggregate, and the number of lines of a head is bounded.
    """
    entry = F.when(F.col("row") < lines, F.struct("row", "line_no", "line", is_comment_line(F.col("line")).alias("comment")))
    best, names = F.col("best"), F.array(*[F.lit(d) for d in candidates])
    found = best.getField("score").isNotNull()
    return (
        _with_counts(head, mode, candidates)
        .groupBy("file_id")
        .agg(
            *[F.avg(f"count_{i}").alias(f"mean_{i}") for i in range(len(candidates))],
            *[F.stddev_pop(f"count_{i}").alias(f"std_{i}") for i in range(len(candidates))],
            *([F.sort_array(F.collect_list(entry)).alias("entries")] if lines else []),
        )
        .withColumn("best", _best(mode, candidates))
        .select(
            "file_id",
            F.when(found, F.element_at(names, 1 - best.getField("preference")))
            .otherwise(DEFAULT_DELIMITER)
            .alias("delimiter"),
            F.coalesce(best.getField("score"), F.lit(-1.0)).alias("delimiter_score"),
            *(["entries"] if lines else []),
        )
    )


def sniff_delimiter(
    head: DataFrame, mode: str = "robust", candidates: tuple[str, ...] = DELIMITERS
) -> DataFrame:
    """One row per file: ``file_id, delimiter, delimiter_score``."""
    return file_heads(head, mode, candidates=candidates)
