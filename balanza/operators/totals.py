"""Totals and quality measures per document and per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.money import is_credit
from balanza.rules.tags import JUNK_CATEGORY, TOTAL_CATEGORIES


def _sum_where(condition: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast("decimal(18,2)"))


def category_totals(mov: DataFrame, by=("doc_id",), fold_mixed: bool = False) -> DataFrame:
    """Sum per category, deposits and category counts, in one grouped pass.

    Mixed fees carry a tag name that the totals do not know, so they count as GENERAL;
    ``fold_mixed`` adds them to the mixed-fee total.
    """
    return mov.groupBy(*by).agg(*_category_sums(fold_mixed))


def _category_sums(fold_mixed: bool = False) -> list[Column]:
    cat = F.upper(F.trim(F.coalesce("category", F.lit("GENERAL"))))
    if fold_mixed:
        cat = F.when(cat == "COMISION_MIXTA", F.lit("COMISION_TPV_MIXTA")).otherwise(cat)
    amount = F.col("amount")
    known = cat.isin("DEPOSITOS", *TOTAL_CATEGORIES)
    return [
        *[_sum_where(cat == c, amount).alias(c.lower()) for c in TOTAL_CATEGORIES],
        (_sum_where(is_credit(F.col("kind")), amount)).alias("depositos"),
        F.count_if(cat == "TPV").alias("n_tpv"),
        F.count_if(known & (cat != "TPV")).alias("n_otros"),
        F.count_if(~known & (cat != JUNK_CATEGORY)).alias("n_general"),
        F.count(F.lit(1)).alias("n_movements"),
    ]


def fee_columns(fees: Column) -> dict[str, Column]:
    """Fee total over card types, and card sales net of the declared fees."""
    return {
        "fees_total": F.col("comision_cr") + F.col("comision_db") + F.col("comision_amex") + F.col("comision_tpv_mixta"),
        "tpv_net": F.col("tpv") - F.coalesce(fees, F.lit(0).cast("decimal(18,2)")),
    }


def fee_rollup(totals: DataFrame, covers: DataFrame, on="doc_id", fees: str = "fees") -> DataFrame:
    """Adds ``fee_columns`` with the fees that the covers declare."""
    declared = covers.select(on, F.col(fees).alias("_fees"))
    return totals.join(declared, on, "left").withColumns(fee_columns(F.col("_fees"))).drop("_fees")


def _similarity(read: Column, declared: Column) -> Column:
    low, high = F.least(read, declared).cast("double"), F.greatest(read, declared).cast("double")
    return (
        F.when((read == 0) & (declared == 0), F.lit(100.0))
        .when((read == 0) | (declared == 0), F.lit(0.0))
        .otherwise(F.try_divide(low, high) * 100.0)
    )


def extracted_sums(mov: DataFrame, by=("doc_id",)) -> DataFrame:
    """Sums of exactly ABONO and CARGO, and the share of rows with a category, in percent."""
    return mov.groupBy(*by).agg(*_read_sums())


def _read_sums() -> list[Column]:
    kind = F.upper(F.trim("kind"))
    return [
        _sum_where(kind == "ABONO", F.col("amount")).alias("credits_read"),
        _sum_where(kind == "CARGO", F.col("amount")).alias("charges_read"),
        F.avg(F.when(F.col("category") != "GENERAL", 100.0).otherwise(0.0)).alias("categorized_pct"),
    ]


def statement_sums(mov: DataFrame, by=("doc_id",)) -> DataFrame:
    """Category totals and quality sums in one pass over the movements."""
    return mov.groupBy(*by).agg(*_category_sums(), *_read_sums())


def extraction_quality(sums: DataFrame, covers: DataFrame, on="doc_id", keep=()) -> DataFrame:
    """Confidence (mean of the two similarities) and absolute gaps against the declared sums; ``keep``
    names more columns of the covers to carry along."""
    zero = F.lit(0).cast("decimal(18,2)")
    declared = covers.select(
        on, F.coalesce("deposits", zero).alias("deposits"), F.coalesce("charges", zero).alias("charges"), *keep
    )
    return sums.join(declared, on, "left").withColumns({
        "deposits": F.coalesce("deposits", zero),
        "charges": F.coalesce("charges", zero),
    }).withColumns({
        "confidence": F.round(
            (_similarity(F.col("credits_read"), F.col("deposits")) + _similarity(F.col("charges_read"), F.col("charges"))) / 2.0, 2
        ),
        "gap_deposits": F.abs(F.col("deposits") - F.col("credits_read")),
        "gap_charges": F.abs(F.col("charges") - F.col("charges_read")),
    })


def page_quality(pages: DataFrame, by=("doc_id",)) -> DataFrame:
    """Pages and failed pages: score 0, or an alert that says ERROR."""
    failed = (F.coalesce("score", F.lit(1.0)) == 0.0) | F.upper(F.coalesce("alert", F.lit(""))).contains("ERROR")
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(failed).alias("failed_pages"))


def page_metrics(mov: DataFrame, layouts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per page inside its account range: movements, score 1.0 for an own header and 0.5 for an
    inherited one, alert text, and mean time per page of the account."""
    per_page = mov.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("movements"))
    paged = ranges.withColumn("page", F.explode(F.sequence("first_page", "last_page")))
    inside = layouts.join(paged.withColumn("page", F.col("page").cast(layouts.schema["page"].dataType)), ["doc_id", "page"])
    return inside.join(per_page, ["doc_id", "page"], "left").select(
        "doc_id", "page",
        F.coalesce("movements", F.lit(0)).alias("movements"),
        F.when(F.col("own_header"), 1.0).otherwise(0.5).alias("score"),
        F.when(F.col("own_header"), F.lit("OK")).otherwise(F.lit("Layout Heredado")).alias("alert"),
        F.floor(F.col("elapsed_ms") / (F.col("last_page") - F.col("first_page") + 1)).alias("page_ms"),
    )


def job_totals(covers: DataFrame, by="job_id", threshold: int = 250_000) -> DataFrame:
    """Deposits per job and the two threshold flags: ``>=`` gates intake, ``>`` goes to the report."""
    total = F.coalesce(F.sum(F.coalesce("deposits", F.lit(0).cast("decimal(18,2)"))), F.lit(0).cast("decimal(18,2)"))
    return covers.groupBy(by).agg(total.alias("total_deposits"), F.count(F.lit(1)).alias("accounts")).withColumns({
        "gate_flag": F.col("total_deposits") >= threshold,
        "report_flag": F.col("total_deposits") > threshold,
    })
