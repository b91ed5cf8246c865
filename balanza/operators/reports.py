"""Report data sets: one frame per sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions import dates as D
from balanza.functions.ids import account_label
from balanza.functions.money import fix_percent

ERROR_BANKS = ("ERROR_CIFRADO", "ERROR_LECTURA", "ERROR_PROCESAMIENTO")


def reportable(df: DataFrame) -> DataFrame:
    """Without documents marked as duplicates."""
    return df.filter(F.upper(F.coalesce("bank", F.lit(""))) != "DUPLICADO")


def account_summary(totals: DataFrame, covers: DataFrame) -> DataFrame:
    """Twelve columns per account; unreadable documents keep a row with their error and zeros."""
    rows = reportable(covers).join(totals.select(
        "doc_id", "tpv", "financiamiento", "efectivo", "traspaso_abono", "traspaso_cargo", "bmrcash", "moratorios"
    ), "doc_id", "left")
    bad = F.col("bank").isin(*ERROR_BANKS)
    zero = F.lit(0.0)

    def amount(name):
        return F.when(bad, zero).otherwise(F.coalesce(F.col(name), zero))

    return rows.select(
        F.when(bad, F.lit("N/A")).otherwise(F.coalesce(F.col("period_end").cast("string"), F.col("period_start").cast("string"), F.lit("Desc."))).alias("month"),
        F.when(bad, F.coalesce("file_name", F.lit("Archivo Desconocido"))).otherwise(account_label(F.col("bank"), F.col("clabe"))).alias("account"),
        F.when(bad, F.lit("N/A")).otherwise(F.lit("MXN")).alias("currency"),
        F.when(F.col("bank") == "ERROR_CIFRADO", F.lit("CON CONTRASEÑA")).when(bad, F.lit("ERROR DE PROCESAMIENTO")).alias("error"),
        amount("deposits").alias("deposits"), amount("charges").alias("charges"), amount("tpv").alias("tpv"),
        amount("financiamiento").alias("financing"), amount("efectivo").alias("cash"),
        amount("traspaso_abono").alias("transfers_in"), amount("traspaso_cargo").alias("transfers_out"),
        amount("bmrcash").alias("marketplace"), amount("moratorios").alias("late_fees"),
    )


def cover_summary(totals: DataFrame, covers: DataFrame) -> DataFrame:
    """Declared and read amounts per cover, with card sales net of declared fees."""
    rows = reportable(covers).join(totals.select(
        "doc_id", "tpv", "financiamiento", "efectivo", "bmrcash", "moratorios", "pago_financiamiento"
    ), "doc_id")
    return rows.select(
        "doc_id", "job_id", account_label(F.col("bank"), F.col("clabe")).alias("account"), "period_start", "period_end",
        "deposits", "charges", "fees", "tpv", (F.col("tpv") - F.col("fees")).alias("tpv_net"),
        "financiamiento", "efectivo", "bmrcash", "moratorios", "pago_financiamiento",
    )


# The detail sheets of a statement report and the categories each lists (all of them where none is named).
DETAIL_SHEETS = (
    ("todos_los_movimientos", ()),
    ("transacciones_tpv", ("TPV",)),
    ("efectivo", ("EFECTIVO",)),
    ("financiamientos", ("FINANCIAMIENTO",)),
    ("traspasos_abonos", ("TRASPASO_ABONO",)),
    ("traspasos_cargos", ("TRASPASO_CARGO",)),
    ("bmrcash", ("BMRCASH",)),
    ("moratorios", ("MORATORIOS",)),
    ("comisiones_tpv", ("COMISION_CR", "COMISION_DB", "COMISION_AMEX", "COMISION_TPV_MIXTA")),
    ("pagos_financiamiento", ("PAGO_FINANCIAMIENTO",)),
)


def detail_sheets(mov: DataFrame, provider: Column) -> DataFrame:
    """Movements on each sheet that lists them, in one pass: sheet, job_id, doc_id, mov_id, bank, period, posted,
    description, amount, kind, category, provider.

    ``provider`` is worked out for card sales only and shown on their sheet. Junk and rows of kind importe are on none; a
    movement without a category is GENERAL, and an amount that is none is 0.
    """
    category = F.upper(F.coalesce("category", F.lit("GENERAL")))
    listed = F.array_compact(F.array(*[F.when(category.isin(*names) if names else F.lit(True), F.lit(sheet)) for sheet, names in DETAIL_SHEETS]))
    rows = mov.filter((category != "BASURA_OCR") & (F.lower(F.trim(F.coalesce("kind", F.lit("")))) != "importe"))
    named = rows.select("job_id", "doc_id", "mov_id", "bank", "period", "posted", "description", F.coalesce("amount", F.lit(0)).alias("amount"), "kind", category.alias("category"),
                        F.when(category == "TPV", provider).alias("provider"), listed.alias("_sheets"))
    out = named.select(F.explode("_sheets").alias("sheet"), *named.drop("_sheets").columns)
    return out.withColumn("provider", F.when(F.col("sheet") == "transacciones_tpv", F.col("provider")))


def cover_sheet(covers: DataFrame, sums: DataFrame, quality: DataFrame, pages: DataFrame) -> DataFrame:
    """The 23 columns of a cover, with doc_id and job_id before them.

    ``covers`` has bank, rfc, holder, clabe, file_name, the period, declared sums, average_balance and fees; ``sums`` the
    category sums of a document, ``quality`` what was read of it, ``pages`` its pages. Duplicates have no row. A document
    that could not be read has its file's name and the reason in ``message``, N/A and zeros.
    """
    rows = reportable(covers)
    for other in (sums.select("doc_id", "comision_cr", "comision_db", "comision_amex", "comision_tpv_mixta", "pago_financiamiento"),
                  quality.select("doc_id", "credits_read", "charges_read", "confidence", "gap_deposits", "gap_charges", "categorized_pct"), pages.select("doc_id", "pages", "failed_pages")):
        rows = rows.join(other, "doc_id", "left")
    bank = F.upper(F.coalesce("bank", F.lit("BANCO")))
    bad = bank.isin(*ERROR_BANKS)

    def number(x: Column) -> Column:
        return F.when(bad, F.lit(0.0)).otherwise(F.coalesce(x.cast("double"), F.lit(0.0)))

    def text(name: str) -> Column:
        return F.when(bad, F.lit("N/A")).otherwise(F.coalesce(F.col(name).cast("string"), F.lit("")))

    def count(name: str) -> Column:
        return F.when(bad, F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("bigint")

    fees = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("comision_cr", "comision_db", "comision_amex", "comision_tpv_mixta")]
    return rows.select(
        "doc_id", "job_id", bank.alias("bank"), text("rfc").alias("rfc"), text("holder").alias("holder"),
        F.when(bad, F.coalesce("file_name", F.lit("N/A"))).otherwise(F.coalesce("clabe", F.lit(""))).alias("clabe"),
        text("period_start").alias("period_start"), text("period_end").alias("period_end"),
        F.when(bank == "ERROR_CIFRADO", F.lit("CON CONTRASEÑA")).when(bad, F.lit("ERROR DE PROCESAMIENTO")).alias("message"),
        number(F.col("deposits")).alias("deposits"), number(F.col("charges")).alias("charges"), number(F.col("credits_read")).alias("deposits_read"), number(F.col("charges_read")).alias("charges_read"),
        number(F.col("average_balance")).alias("average_balance"), number(F.col("fees")).alias("fees"),
        number(fees[0]).alias("fees_credit"), number(fees[1]).alias("fees_debit"), number(fees[2]).alias("fees_amex"), number(fees[0] + fees[1] + fees[2] + fees[3]).alias("fees_total"),
        number(F.col("pago_financiamiento")).alias("financing_payments"), number(F.col("confidence")).alias("confidence"),
        number(F.col("gap_deposits")).alias("gap_deposits"), number(F.col("gap_charges")).alias("gap_charges"), number(F.col("categorized_pct")).alias("categorized_pct"),
        count("pages").alias("pages"), count("failed_pages").alias("failed_pages"),
    )


def traffic_light(score: Column) -> Column:
    return F.when(score >= 0.9, "green").when(score >= 0.7, "yellow").otherwise("red")


def qa_pages(metrics: DataFrame) -> DataFrame:
    """Page quality with a traffic light for the score and for the alert."""
    alert = F.coalesce("alert", F.lit("OK"))
    return metrics.withColumns({
        "light": traffic_light(F.coalesce("score", F.lit(0.0))),
        "alert_light": F.when(alert == "OK", F.lit("none")).otherwise(F.lit("yellow")),
        "seconds": F.col("page_ms") / 1000.0,
    })


def key_values(df: DataFrame, block: str, pairs: dict[str, Column], key: str = "taxpayer") -> DataFrame:
    """One row per named value, as (key, block, name, value)."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs.items()])
    return df.select(key, F.lit(block).alias("block"), F.explode(items).alias("kv")).select(key, "block", "kv.name", "kv.value")


def unpivot_pivot(df: DataFrame, ids: list[str], across: str, across_values, values: list[str], name: str = "metric") -> DataFrame:
    """Turns measure columns into rows and the values of ``across`` into columns."""
    long = df.select(*ids, across, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        [*ids, across], values, name, "_value"
    )
    return long.groupBy(*ids, name).pivot(across, list(across_values)).agg(F.first("_value"))


def network_report(nodes: DataFrame, as_of) -> DataFrame:
    """Concentration table with age from the tax id and the share as a fraction."""
    return nodes.withColumns({
        "age": D.rfc_age(F.col("rfc"), as_of), "share_fixed": fix_percent(F.col("share")),
    })


def scenario_matrix(series: DataFrame, points: DataFrame, digits: int = 2, months: int = 12) -> DataFrame:
    """Twelve past and twelve future months per metric, model and scenario; short histories are
    padded with zeros on the left. Columns h01..h12 and p01..p12."""
    from pyspark.sql import Window

    w = Window.partitionBy("taxpayer", "metric").orderBy(F.col("month").desc())
    placed = series.withColumn("_back", F.row_number().over(w))
    past = placed.filter(F.col("_back") <= months).groupBy("taxpayer", "metric").agg(*[
        F.round(F.coalesce(F.max(F.when(F.col("_back") == months + 1 - i, F.col("amount").cast("double"))), F.lit(0.0)), digits).alias(f"h{i:02d}")
        for i in range(1, months + 1)
    ])
    future = points.groupBy("taxpayer", "metric", "model", "scenario").agg(*[
        F.round(F.max(F.when(F.col("step") == i, F.col("value"))), digits).alias(f"p{i:02d}") for i in range(1, months + 1)
    ])
    return future.join(past, ["taxpayer", "metric"])


def credit_detail(lines: DataFrame) -> DataFrame:
    """Bureau lines as listed: labels, dates for display and the MOP month."""
    return lines.withColumns({
        "opened_shown": D.short_us_date(F.col("opened")),
        "final_shown": F.coalesce(D.short_us_date(F.col("final_date")), F.lit("")),
        "mop_month": F.coalesce(D.month_label(F.col("opened")), F.lit("N/A")),
    })


def concentration_matrix(months: DataFrame, top: DataFrame, as_months: list) -> DataFrame:
    """Monthly amounts of the listed counterparties, one column per month, 0 where there is none."""
    rows = months.join(top.select("taxpayer", "counterparty", "total").withColumnRenamed("total", "amount"), ["taxpayer", "counterparty"])
    label = F.date_format("month", "yyyy-MM")
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.groupBy("taxpayer", "counterparty").agg(
        F.first("amount").alias("total"), *[F.coalesce(F.sum(F.when(label == m, F.col("total"))), zero).alias(m) for m in as_months]
    )
