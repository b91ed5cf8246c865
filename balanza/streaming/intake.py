"""Incremental intake: files already seen for a job within the result lifetime are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: how long a result is kept.
LIFETIME = "1 hour"


def stream_intake(files: DataFrame, lifetime: str = LIFETIME) -> DataFrame:
    """First sight of each (job_id, hash) within ``lifetime`` of event time.

    ``files`` is a stream with job_id, hash and ts; state is dropped as the watermark passes.
    """
    timed = files.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", lifetime).dropDuplicatesWithinWatermark(["job_id", "hash"])
