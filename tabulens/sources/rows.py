"""Row numbers and chunks without a global sort or a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: rows per chunk.
CHUNK_ROWS = 10_000
# Upper bound of the offsets table that numbering broadcasts.
MAX_BUCKETS = 100_000


def number_rows(df: DataFrame, order: str, name: str = "_row_idx", buckets: int = MAX_BUCKETS) -> DataFrame:
    """Number rows 0, 1, ... by ``order``, an integer column of distinct values; a null value is an error.

    Values that already run without a gap only need their minimum taken off; that each is there once is seen by a
    checksum. Otherwise the value range is cut into at most ``buckets`` ranges, whose row counts (one small row each)
    give every range its offset; rows are then ranked inside their range only. A range holds at most its width in
    rows where values are distinct, so no key can become hot; equal values are numbered one after the other.
    """
    key = F.col(order).cast("long")
    low, high, n, rows, check = df.agg(F.min(key), F.max(key), F.count(key), F.count(F.lit(1)), F.bit_xor(F.xxhash64(key))).first()
    if rows > n:
        raise ValueError(f"{rows - n} rows have no {order}")
    if n == 0:
        return df.withColumn(name, F.lit(0).cast("long"))
    if high - low + 1 == n and check == df.sparkSession.range(low, high + 1).agg(F.bit_xor(F.xxhash64("id"))).first()[0]:
        return df.withColumn(name, (F.col(order) - F.lit(low)).cast("long"))
    width = -(-(high - low + 1) // buckets)
    bucket = F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("long")
    bucketed = df.withColumn("_bucket", bucket)
    counts = sorted((r[0], r[1]) for r in bucketed.groupBy("_bucket").count().collect())
    offsets, total = [], 0
    for key, count in counts:
        offsets.append((key, total))
        total += count
    offsets_df = df.sparkSession.createDataFrame(offsets, "_bucket long, _offset long")
    inside = Window.partitionBy("_bucket").orderBy(order)
    return (
        bucketed.join(F.broadcast(offsets_df), "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def number_lines(lines: DataFrame, name: str = "row") -> DataFrame:
    """Number the lines of every file 0, 1, ... from their ``line_no`` of ``(block, position)``.

    Positions run without a gap inside a file split, so a split's offset is all that is missing. One row per
    split carries the counts; the lines themselves are not moved unless the splits table is too large to
    broadcast, which Spark decides from its measured size.
    """
    splits = lines.groupBy("file_id", F.col("line_no.block").alias("_block")).agg(
        F.count(F.lit(1)).alias("_lines_here"), F.min("line_no.position").alias("_first")
    )
    before = Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines_here").over(before), F.lit(0)))
    return (
        lines.withColumn("_block", F.col("line_no.block"))
        .join(splits, ["file_id", "_block"])
        .withColumn(name, F.col("_before") + F.col("line_no.position") - F.col("_first"))
        .drop("_block", "_lines_here", "_first", "_before")
    )


def number_records(records: DataFrame, name: str = "row") -> DataFrame:
    """The same for lines whose positions have gaps: they are counted inside their split, which bounds the work of a task."""
    inside = Window.partitionBy("file_id", "_block").orderBy("line_no")
    splits = records.groupBy("file_id", F.col("line_no.block").alias("_block")).agg(F.count(F.lit(1)).alias("_lines_here"))
    before = Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines_here").over(before), F.lit(0))).drop("_lines_here")
    counted = records.withColumn("_block", F.col("line_no.block")).withColumn("_nth", F.row_number().over(inside))
    return counted.join(splits, ["file_id", "_block"]).withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_block", "_before", "_nth")


def chunk_id(row_idx: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(row_idx / F.lit(chunk_rows)).cast("long")


def with_chunks(df: DataFrame, row_idx: str = "_row_idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn("_chunk_id", chunk_id(F.col(row_idx), chunk_rows))


def chunk_offsets(chunked: DataFrame, row_idx: str = "_row_idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: where it starts and how many rows it has."""
    return chunked.groupBy(*keys, "_chunk_id").agg(
        F.min(row_idx).alias("row_offset"), F.count(F.lit(1)).alias("chunk_rows")
    )
