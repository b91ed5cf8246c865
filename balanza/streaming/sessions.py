"""Upload sessions: the files of a job within a gap belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.functions.dates import as_date, month_start


def stream_sessions(files: DataFrame, as_of, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per job and session: files, and whether the required months are covered when it closes."""
    now = month_start(as_date(as_of))
    timed = files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    flags = [
        F.coalesce(F.max((F.col("period") == F.date_format(F.add_months(now, -i), "MM-yyyy")).cast("int")), F.lit(0)).alias(f"m{i}") for i in (1, 2, 3, 4)
    ]
    grouped = timed.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("files"), *flags)
    recent = (F.col("m1") + F.col("m2") + F.col("m3") == 3) | (F.col("m2") + F.col("m3") + F.col("m4") == 3)
    return grouped.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "files", recent.alias("complete"))
