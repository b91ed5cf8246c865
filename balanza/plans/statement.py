"""Statement analytics end to end: classify, mark own transfers, total, and measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.operators import classify, own_transfer, totals
from balanza.rules.tags import TAG_RULES


def summarize(mov: DataFrame, covers: DataFrame, rules=TAG_RULES) -> DataFrame:
    """One row per statement: totals by category, fee roll-up, confidence and gaps.

    Totals and quality sums share one grouped pass over the movements, and meet the covers once.
    """
    rows = classify.classify(mov, rules)
    out = totals.extraction_quality(totals.statement_sums(rows), covers, keep=("fees",))
    out = out.withColumns(totals.fee_columns(F.col("fees"))).drop("fees")
    return out.withColumn("categorized_pct", F.round("categorized_pct", 4)).drop(
        "credits_read", "charges_read", "deposits", "charges"
    )


def analyze_job(mov: DataFrame, covers: DataFrame, labels: DataFrame | None = None, rules=TAG_RULES) -> DataFrame:
    """Classified movements of whole jobs with own transfers marked.

    ``covers`` has job_id, clabe and holder; ``labels`` has mov_id and label.
    """
    tagged = classify.decide_movements(mov, rules)
    if labels is None:
        rows = tagged.withColumn("category", F.coalesce("category", F.lit("GENERAL")))
    else:
        rows = classify.merge_labels(tagged, labels, "mov_id")
    names = own_transfer.name_pool(covers)
    return own_transfer.apply_own(
        rows,
        own_transfer.own_by_account(rows, own_transfer.account_pool(covers)),
        own_transfer.own_by_name_exact(rows, names),
        own_transfer.own_by_name_fuzzy(rows, names),
    )
