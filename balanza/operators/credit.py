"""Credit-bureau reports: lines, summary, past-due brackets, inquiries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.dates import lookup
from balanza.operators.ordered import attach_group
from balanza.rules.catalog import CREDIT_TYPES, PAST_DUE_BUCKETS

# Day counts of a month and a year in the term and payment formulas.
MONTH_DAYS, TERM_YEAR_DAYS = 30.4, 360


def past_due_amount(stated: Column) -> Column:
    """The stated past-due amount, or the sum of the six brackets where none is stated."""
    total = F.lit(0).cast("decimal(18,2)")
    for b in PAST_DUE_BUCKETS:
        total = total + F.coalesce(F.col(f"due_{b}"), F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(stated, total)


def credit_lines(raw: DataFrame) -> DataFrame:
    """Lines with label, past due, final date, weight in the report, days left, weighted days and
    monthly payment. The report's total is grouped and attached, so a large report stays spread."""
    sums = raw.groupBy("report_id").agg(F.sum("balance").alias("_total"), F.count(F.lit(1)).alias("_n"))
    rows = attach_group(raw, sums, ["report_id"])
    final = F.when(F.col("opened").isNotNull() & (F.col("term_days") > 0), F.date_add("opened", F.col("term_days")))
    staged = rows.withColumns({
        "account_type": F.coalesce(lookup(F.col("code"), CREDIT_TYPES), F.col("code")),
        "past_due": past_due_amount(F.col("stated_past_due")),
        "final_date": final,
        "weight": F.when(F.col("_total") > 0, F.col("balance").cast("double") / F.nullif(F.col("_total").cast("double"), F.lit(0.0))).otherwise(0.0),
    }).withColumn("days_left", F.when(F.col("final_date") >= F.col("report_date"), F.datediff("final_date", "report_date")).otherwise(0))
    balance = F.col("balance").cast("double")
    payment = (
        F.when(F.col("balance") <= 0, F.lit(0.0)).when(F.col("days_left") < MONTH_DAYS, balance)
        .otherwise(balance / F.nullif(F.col("days_left") / F.lit(MONTH_DAYS), F.lit(0.0)))
    )
    return staged.withColumns({
        "weighted_days": F.bround(F.col("weight") * F.col("days_left"), 0), "monthly_payment": payment,
    }).drop("_total")


def credit_summary(lines: DataFrame, trend: DataFrame | None = None) -> DataFrame:
    """Open and past-due sums, weighted term in years and the two monthly payments per report."""
    is_open = F.coalesce(F.col("closed").cast("string"), F.lit("")).isin("", "None", "N/A")
    zero = F.lit(0).cast("decimal(18,2)")
    out = lines.groupBy("report_id").agg(
        F.coalesce(F.sum(F.when(is_open, F.col("initial_balance"))), zero).alias("open_initial"),
        F.coalesce(F.sum("balance"), zero).alias("balance"), F.coalesce(F.sum("past_due"), zero).alias("past_due"),
        F.coalesce(F.sum(F.when(is_open, F.col("past_due"))), zero).alias("open_past_due"),
        F.sum(F.col("monthly_payment").cast("decimal(28,6)")).cast("double").alias("monthly_payment_1"), F.sum("weighted_days").alias("_days"),
    ).withColumn("term_years", F.when(F.col("_days") > 0, F.round(F.col("_days") / TERM_YEAR_DAYS, 2)).otherwise(0.0))
    out = out.withColumn(
        "monthly_payment_2", F.when(F.col("term_years") > 0, F.col("balance").cast("double") / F.nullif(F.col("term_years"), F.lit(0.0)) / 12).otherwise(0.0)
    ).drop("_days")
    if trend is None:
        return out
    pct = F.coalesce("trend_pct", F.lit(0.0))
    return out.join(trend, "report_id", "left").withColumns({
        "trend_pct": pct,
        "trend_text": F.when(pct > 0, F.lit("Han ido aumentando sus consultas")).when(pct < 0, F.lit("Han ido disminuyendo sus consultas")).otherwise(F.lit("Estables")),
    })


def past_due_buckets(lines: DataFrame) -> DataFrame:
    """One row per report and bracket: amount and share of the current balance."""
    sums = lines.groupBy("report_id").agg(
        F.sum("balance").cast("double").alias("_balance"), *[F.sum(f"due_{b}").cast("double").alias(b) for b in PAST_DUE_BUCKETS]
    )
    return sums.unpivot(["report_id", "_balance"], list(PAST_DUE_BUCKETS), "bucket", "amount").select(
        "report_id", "bucket", "amount",
        F.when(F.col("_balance") > 0, F.round(F.col("amount") / F.nullif(F.col("_balance"), F.lit(0.0)), 4)).otherwise(0.0).alias("share"),
    )


def inquiry_summary(counters: DataFrame) -> DataFrame:
    """Rows per report, kind and span with monthly average and growth against the longer span.

    ``counters`` has report_id, kind, over_24, last_24, last_12 and last_3.
    """
    avg24, avg12, avg3 = (F.col(f"last_{m}") / F.lit(float(m)) for m in (24, 12, 3))

    def growth(now, before):
        return F.when(before > 0, now / F.nullif(before, F.lit(0.0)) - 1).otherwise(0.0)

    none = F.lit(None).cast("double")

    def row(span, quantity, months, average, change):
        return F.struct(
            F.lit(span).alias("span"), F.col(quantity).alias("quantity"), F.lit(months).cast("double").alias("months"),
            F.round(average, 2).alias("monthly_average"), F.round(change, 4).alias("growth"),
        )

    rows = F.array(
        row("over_24", "over_24", None, none, none), row("last_24", "last_24", 24, avg24, none),
        row("last_12", "last_12", 12, avg12, growth(avg12, avg24)), row("last_3", "last_3", 3, avg3, growth(avg3, avg12)),
    )
    return counters.select("report_id", "kind", F.explode(rows).alias("r")).select("report_id", "kind", "r.*")


def bureau_normalize(reports: DataFrame, body: str = "body") -> DataFrame:
    """Persons' and companies' bureau reports in one shape: score, lines and inquiries as VARIANT arrays."""
    def node(path, kind):
        return F.try_variant_get(F.col(body), path, kind)

    many = "array<variant>"
    score = F.coalesce(node("$.score[0].valorScore", "string"), node("$.score", "string"), F.lit("N/A"))
    lines = F.coalesce(node("$.creditoFinanciero", many), node("$.respuesta.persona.cuentas", many))
    asked = F.coalesce(
        node("$.historialConsultas", many), F.when(node("$.historialConsultas", "variant").isNotNull(), F.array(node("$.historialConsultas", "variant"))),
        node("$.respuesta.persona.consultaEfectuadas", many),
    )
    empty = F.array().cast(many)
    return reports.withColumns({
        "score": score, "lines": F.coalesce(lines, empty), "inquiries": F.coalesce(asked, empty),
        "shape": F.when(node("$.creditoFinanciero", many).isNotNull(), F.lit("company")).when(node("$.respuesta.persona", "variant").isNotNull(), F.lit("person")),
    })


def bureau_inquiries(rows: DataFrame) -> DataFrame:
    """Inquiry rows with institution fallback, contract label and clean amount and date."""
    from balanza.functions.dates import bureau_date
    from balanza.functions.money import bureau_amount

    code = F.coalesce(F.col("contract_code"), F.lit("N/A"))
    return rows.withColumns({
        "institution": F.coalesce(F.nullif(F.col("grantor"), F.lit("")), F.nullif(F.col("user_type"), F.lit("")), F.lit("N/A")),
        "contract_type": F.coalesce(lookup(code, CREDIT_TYPES), code),
        "inquiry_date": bureau_date(F.col("raw_date")),
        "amount": bureau_amount(F.col("raw_amount")),
    })
