"""Event-time aggregates on streams. The reference workload is batch; these are an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Counts by window and keys; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def upsert_batches(table, on: list[str]):
    """A foreachBatch function that merges each batch into a versioned table; a batch that was merged before is skipped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done = f"batch-{batch_id}"
        if done not in table._names("labels"):
            table.merge(batch, on)
            table.label(done)

    return run
