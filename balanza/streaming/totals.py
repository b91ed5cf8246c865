"""Live category totals: stateless classification, then windowed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.operators.classify import classify
from balanza.rules.tags import TAG_RULES


def stream_totals(mov: DataFrame, rules=TAG_RULES, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sum and count per document, category and window of event time ``ts``.

    Partial sums are combined before the shuffle; closed windows leave the state.
    """
    rows = classify(mov.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), rules)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "doc_id", "category").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "doc_id", "category", "total", "n")
