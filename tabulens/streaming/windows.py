"""Event-time chunks: numeric profiles per time window with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulens.operators.tablefacts import quoted


def window_profile(
    events: DataFrame, time: str, value: str, length: str = "1 day", lateness: str = "1 day"
) -> DataFrame:
    """``window_start, rows, null_rate, mean, std, skew, distinct_approx`` per window, batch or stream.

    All aggregates merge, so state is one row per open window and rows beyond the watermark are dropped. Exact
    distinct counts would need every value and are left to ``profile_stream``.
    """
    stamped = events.withColumn("_time", quoted(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_time", lateness)
    x = quoted(value).cast("double")
    return (
        stamped.groupBy(F.window("_time", length))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            (F.count(F.when(x.isNull(), 1)) / F.count(F.lit(1))).alias("null_rate"),
            F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("std"),
            F.skewness(x).alias("skew"),
            F.approx_count_distinct(x).alias("distinct_approx"),
        )
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )


def closed_windows(profile: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every window once, when the watermark has passed it, below ``out``; rows that come later are dropped.

    State is the windows still open. A batch overwrites its own folder, so one that is run again leaves one result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        profile.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def updated_windows(profile: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write windows as they change, below ``out``: a row for each window that a batch touched, numbered by ``batch_id``.

    The last row of a window, see `latest_windows`, is all that is known of it, so a finished stream has all its windows,
    the open ones too. Rows behind the watermark are dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        profile.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(updates: DataFrame) -> DataFrame:
    """One row per window of what `updated_windows` wrote: the one of its last batch."""
    names = [c for c in updates.columns if c != "batch_id"]
    last = updates.groupBy("window_start").agg(F.max_by(F.struct(*names), "batch_id").alias("x"))
    return last.select("x.*")
