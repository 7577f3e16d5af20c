"""Chunk-at-a-time processing as a stream: every micro-batch is a chunk that is profiled and scored by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulens.operators import anomaly, histogram, profile


def _rows_before(spark: SparkSession, out: str, batch_id: int) -> int:
    """Rows of all earlier batches, from the record of the last one, so that a repeated batch gets the same offset."""
    if batch_id == 0:
        return 0
    schema = "batch long, row_offset long, chunk_rows long"
    last = spark.read.schema(schema).json(f"{out}/batches/batch_{batch_id - 1}").first()
    return last["row_offset"] + last["chunk_rows"]


def profile_stream(
    stream: DataFrame, out: str, checkpoint: str, order: str = "_row_idx", scores: bool = True
) -> StreamingQuery:
    """Write ``profiles``, ``rows`` and ``batches`` of every micro-batch below ``out``.

    Each batch overwrites its own folders, so a batch that is run again after a failure leaves one result.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            columns = histogram.data_columns(batch, exclude=(order,))
            hist = histogram.value_histogram(batch, columns, order=order)
            profile.column_profile(hist, source=batch, columns=columns, order=order).write.mode("overwrite").parquet(f"{out}/profiles/batch_id={batch_id}")
            if scores:
                marked = anomaly.mark_anomalies(batch, columns=columns)
                marked.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
            summary = batch.agg(F.count(F.lit(1)).alias("chunk_rows")).select(
                F.lit(batch_id).cast("long").alias("batch"),
                F.lit(_rows_before(spark, out, batch_id)).cast("long").alias("row_offset"),
                "chunk_rows",
            )
            summary.write.mode("overwrite").json(f"{out}/batches/batch_{batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
