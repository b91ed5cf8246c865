"""Customers and suppliers: concentration, trade network, financial institutions, blacklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from balanza.functions.dates import as_date, in_lookback, month_start
from balanza.functions.stats import line
from balanza.operators.ordered import attach_group, top_k
from balanza.rules.catalog import RED_FLAG_STATUS

NODE = ("taxpayer", "counterparty")


def trend_word(slope: Column, months: Column) -> Column:
    """Growing above 100, shrinking below -100; no word under two closed months."""
    return (
        F.when(months < 2, F.lit("Sin datos")).when(slope > 100, F.lit("Creciendo")).when(slope < -100, F.lit("Disminuyendo")).otherwise(F.lit("Constante"))
    )


def node_months(inv: DataFrame) -> DataFrame:
    """Invoiced amount per counterparty and month: the step that everything below reads."""
    return inv.groupBy(*NODE, F.trunc("issued", "month").alias("month")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))


def with_share(nodes: DataFrame, amount: str = "total") -> DataFrame:
    """Adds each node's share of its taxpayer, without gathering a taxpayer's nodes in one task."""
    sums = nodes.groupBy("taxpayer").agg(F.sum(amount).alias("_all"), F.count(F.lit(1)).alias("_n"))
    return attach_group(nodes, sums, ["taxpayer"]).withColumn(
        "share", F.coalesce(F.try_divide(F.col(amount).cast("double"), F.col("_all").cast("double")), F.lit(0.0))
    ).drop("_all")


def concentration(inv: DataFrame, as_of, days: int = 365, slope_digits: int = 2) -> DataFrame:
    """Per counterparty over the look-back: total, share, monthly history, slope over the closed
    months and trend word. A history has at most a month per month of the look-back."""
    months = node_months(inv.filter(in_lookback(F.col("issued"), as_of, days)))
    w = Window.partitionBy(*NODE).orderBy("month")
    closed = F.col("month") != month_start(as_date(as_of))
    placed = months.withColumns({"_closed": closed, "_x": (F.sum(F.when(closed, 1).otherwise(0)).over(w) - 1)})
    slope, _ = line(F.when(F.col("_closed"), F.col("_x")), F.when(F.col("_closed"), F.col("total")))
    nodes = placed.groupBy(*NODE).agg(
        F.min("name").alias("name"), F.sum("total").alias("total"), F.sum("n").alias("invoices"),
        F.array_sort(F.collect_list(F.struct("month", "total"))).alias("history"),
        F.coalesce(slope, F.lit(0.0)).alias("_slope"),
        F.count_if("_closed").alias("closed_months"),
    )
    shared = with_share(nodes)
    return shared.withColumns({
        "slope": F.round("_slope", slope_digits), "trend": trend_word(F.col("_slope"), F.col("closed_months")),
    }).drop("_slope")


def top_counterparties(nodes: DataFrame, k: int = 5) -> DataFrame:
    return top_k(nodes, ["taxpayer"], [F.col("total").desc(), F.col("counterparty")], k)


def trade_network(inv: DataFrame) -> DataFrame:
    """Per counterparty: received, cancelled and its share, discounts, credit notes, pending, net,
    PUE, PPD and its count, paid, instalments and days outstanding, in one grouped pass."""
    zero = F.lit(0).cast("decimal(18,2)")

    def total(condition, col="total"):
        return F.coalesce(F.sum(F.when(condition, F.col(col))), zero)

    def column(name):
        return F.coalesce(F.sum(F.col(name)), zero) if name in inv.columns else zero

    live = F.col("status") != "cancelled"
    nodes = inv.groupBy(*NODE).agg(
        F.min("name").alias("name"), F.coalesce(F.sum("total"), zero).alias("received"), total(~live).alias("cancelled"),
        column("discount").alias("discounts"), column("credit_note").alias("credit_notes"),
        total(F.col("status") == "open").alias("pending"), total(live & (F.col("pay_type") == "PUE")).alias("pue"),
        total(live & (F.col("pay_type") == "PPD")).alias("ppd"), F.count_if(live & (F.col("pay_type") == "PPD")).alias("ppd_count"),
        total(F.col("status") == "paid").alias("paid"), total((F.col("status") == "paid") & (F.col("pay_type") == "PPD")).alias("in_installments"),
    )
    net = F.col("received") - F.col("cancelled") - F.col("discounts") - F.col("credit_notes")
    return nodes.withColumn("net", net).withColumns({
        "cancelled_pct": F.round(F.coalesce(F.try_divide(F.col("cancelled").cast("double"), F.col("received").cast("double")), F.lit(0.0)), 4),
        "days_outstanding": F.round(F.coalesce(F.try_divide(F.col("pending").cast("double"), F.col("net").cast("double")), F.lit(0.0)) * 365, 1),
    })


def institutions(months: DataFrame) -> DataFrame:
    """Per institution: total, first and last month and number of months with a positive amount."""
    positive = F.col("total") > 0
    return months.groupBy(*NODE).agg(
        F.min("name").alias("name"), F.sum("total").alias("total"),
        F.min(F.when(positive, F.col("month"))).alias("first_month"), F.max(F.when(positive, F.col("month"))).alias("last_month"),
        F.count_if(positive).alias("active_months"),
    )


def blacklist_enrich(listed: DataFrame, inv: DataFrame, newest: int | None = None) -> DataFrame:
    """Invoiced total and last date per blacklisted counterparty and side.

    All invoices count; ``newest`` keeps the latest so many per counterparty, as a data provider's
    page would.
    """
    keys = [*NODE, "side"]
    rows = inv.join(listed.select(*keys).distinct(), keys, "left_semi")
    if newest is not None:
        rows = top_k(rows, keys, [F.col("issued").desc(), F.col("invoice_id").desc()], newest)
    sums = rows.groupBy(*keys).agg(F.sum("total").alias("amount"), F.max("issued").alias("last_date"))
    return listed.join(sums, keys, "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(18,2)")))


def blacklist_exposure(listed: DataFrame, order: str = "seq") -> DataFrame:
    """Per counterparty: counts and amounts of both sides, first name and status, last date, red flag."""
    zero = F.lit(0).cast("decimal(18,2)")
    issued, received = F.col("side") == "issued", F.col("side") == "received"
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("N/A"))
    out = listed.filter(F.coalesce(F.col("counterparty").cast("string"), F.lit("N/A")) != "N/A").groupBy(*NODE).agg(
        F.min_by(named, order).alias("name"), F.min_by("status", order).alias("status"),
        F.coalesce(F.sum(F.when(issued, F.col("invoices"))), F.lit(0)).alias("issued_count"),
        F.coalesce(F.sum(F.when(issued, F.col("amount"))), zero).alias("issued_amount"),
        F.coalesce(F.sum(F.when(received, F.col("invoices"))), F.lit(0)).alias("received_count"),
        F.coalesce(F.sum(F.when(received, F.col("amount"))), zero).alias("received_amount"),
        F.max("last_date").alias("last_date"),
    )
    return out.withColumns({
        "total_amount": F.col("issued_amount") + F.col("received_amount"), "red_flag": F.coalesce(F.col("status").isin(*RED_FLAG_STATUS), F.lit(False)),
    })
