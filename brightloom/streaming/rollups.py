"""Structured Streaming: minute rollups, retry deduplication, and the fan-out of log rows to their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.sources import ingest


def minute_stats(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """log_stats of a stream of normalised rows; rows later than the watermark are left out."""
    timed = rows.withColumn("at", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))).withWatermark("at", lateness)
    found = timed.groupBy(F.window("at", "1 minute").alias("w"), "team_id", "stream_id").agg(F.count(F.lit(1)).alias("log_count"), F.sum(F.octet_length("line")).alias("byte_count"))
    return found.select("team_id", "stream_id", F.unix_millis("w.start").alias("bucket_ms"), "log_count", "byte_count")


def without_retries(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A stream of rows without those that were sent again: same tenant, stream, time and line."""
    timed = rows.withColumn("at", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))).withColumn("line_hash", F.xxhash64("line")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(["team_id", "stream_id", "ts_ns", "line_hash"]).drop("at", "line_hash")


def fan_out_writer(base: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a micro-batch of log rows to logs, streams, labels and stats.

    Each batch overwrites its own folder, so a batch that is run again leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            streams = ingest.log_streams(kept)
            tables = {"logs": kept.drop("labels", "resource_attributes"), "streams": streams, "labels": ingest.log_stream_labels(streams), "stats": ingest.log_stats(kept)}
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
        finally:
            kept.unpersist()

    return write


def sample_writer(base: str, known: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a micro-batch of metric rows to series and samples."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            ingest.new_series(kept, known()).write.mode("overwrite").parquet(f"{base}/series/batch={batch_id}")
            ingest.samples(kept).write.mode("overwrite").parquet(f"{base}/samples/batch={batch_id}")
        finally:
            kept.unpersist()

    return write
