"""Monthly series: feeds to months, wide history, windowed statistics, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from balanza.functions.dates import as_date, month_start
from balanza.functions.money import MONEY
from balanza.functions.stats import line


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def feed_amount(mxn: Column, plain: Column) -> Column:
    """The peso amount unless it is missing or 0, else the plain one, else 0."""
    return F.coalesce(F.nullif(mxn, _zero()), plain, _zero())


def monthly_cashflow(feed: DataFrame) -> DataFrame:
    """Inflow and outflow sums and counts per taxpayer and month; other types are passed over."""
    amount = feed_amount(F.col("mxn_amount"), F.col("amount"))
    inflow, outflow = F.col("type") == "inflow", F.col("type") == "outflow"
    return feed.groupBy("taxpayer", "month").agg(
        F.coalesce(F.sum(F.when(inflow, amount)), _zero()).alias("inflow"),
        F.coalesce(F.sum(F.when(outflow, amount)), _zero()).alias("outflow"),
        F.coalesce(F.sum(F.when(inflow, F.col("transactions"))), F.lit(0)).alias("inflow_count"),
        F.coalesce(F.sum(F.when(outflow, F.col("transactions"))), F.lit(0)).alias("outflow_count"),
    )


def monthly_last(feed: DataFrame, order: str = "seq") -> DataFrame:
    """Sales and spend feeds: the last entry of a month holds."""
    amount = feed_amount(F.col("mxn_amount"), F.col("amount"))
    return feed.groupBy("taxpayer", "month").agg(
        F.max_by(amount, order).alias("amount"), F.max_by("transactions", order).alias("n")
    )


def sales_by_payment_type(feed: DataFrame) -> DataFrame:
    """PUE and PPD sales per month, by substring of the payment type."""
    kind = F.upper(F.coalesce("payment_type", F.lit("")))
    amount = feed_amount(F.col("mxn_amount"), F.col("amount"))
    pue = kind.contains("PUE")
    return feed.groupBy("taxpayer", "month").agg(
        F.coalesce(F.sum(F.when(pue, amount)), _zero()).alias("pue"),
        F.coalesce(F.sum(F.when(~pue & kind.contains("PPD"), amount)), _zero()).alias("ppd"),
    )


def raw_history(series: DataFrame) -> DataFrame:
    """One wide row per taxpayer and month, zeros for gaps, from the long monthly series.

    Metrics: revenue, revenue_pue, revenue_ppd, expenditure, inflow, outflow.
    """
    def amount(metric):
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("amount"))), _zero())

    def count(metric):
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("n"))), F.lit(0))

    return series.groupBy("taxpayer", "month").agg(
        amount("revenue").alias("revenue"), amount("revenue_pue").alias("revenue_pue"), amount("revenue_ppd").alias("revenue_ppd"),
        amount("expenditure").alias("expenses"), amount("inflow").alias("inflows"), amount("outflow").alias("outflows"),
        (amount("inflow") - amount("outflow")).alias("nfcf"),
        count("inflow").alias("inflows_count"), count("outflow").alias("outflows_count"),
        F.count_if(F.col("metric").isin("inflow", "outflow")).alias("cash_rows"),
    )


STAT_METRICS = ("revenue", "expenses", "inflows", "outflows", "nfcf")
WINDOWS = (24, 12, 9, 6, 3)


def window_stats(history: DataFrame, as_of, windows=WINDOWS, metrics=STAT_METRICS, digits: int = 2, slope_digits: int = 2) -> DataFrame:
    """Mean, median, growth of sums, slope and CMGR/CAGR over the last closed months.

    Months are those with cash flow. A window shrinks to the history there is; growth needs a
    preceding window of the same length. Everything after the first grouping works on months.
    """
    closed = history.filter((F.col("cash_rows") > 0) & (F.col("month") != month_start(as_date(as_of))))
    newest = Window.partitionBy("taxpayer").orderBy(F.col("month").desc())
    numbered = closed.withColumns({"_back": F.row_number().over(newest), "_all": F.count(F.lit(1)).over(Window.partitionBy("taxpayer"))})
    spread = numbered.select(
        "taxpayer", "_back", "_all", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_months"),
        *metrics,
    ).withColumn("_len", F.least(F.col("window_months"), F.col("_all")))
    used = spread.filter(F.col("_back") <= 2 * F.col("_len")).select(
        "taxpayer", "window_months", "_back", "_all", "_len", *[F.col(m).cast(MONEY).alias(m) for m in metrics]
    ).unpivot(["taxpayer", "window_months", "_back", "_all", "_len"], list(metrics), "metric", "value")
    now = F.col("_back") <= F.col("_len")
    before = ~now & (F.col("_all") >= 2 * F.col("_len"))
    y = F.when(now, F.col("value").cast("double"))
    stats = used.groupBy("taxpayer", "window_months", "metric").agg(
        F.max("_len").alias("months"), F.max("_all").alias("_all"),
        (F.sum(F.when(now, F.col("value"))).cast("double") / F.max("_len")).alias("mean"),
        F.median(y).alias("median"),
        F.sum(F.when(now, F.col("value"))).cast("double").alias("_sum"),
        F.coalesce(F.sum(F.when(before, F.col("value"))), _zero()).cast("double").alias("_prev"),
        line(F.when(now, F.col("_len") - F.col("_back")), F.when(now, F.col("value")))[0].alias("slope"),
        F.max_by(y, F.when(now, F.col("_back"))).alias("_first"),
        F.min_by(y, F.when(now, F.col("_back"))).alias("_last"),
    )
    growth = F.when(
        F.col("_all") >= 2 * F.col("months"),
        F.when(F.col("_prev") != 0, (F.col("_sum") - F.col("_prev")) / F.abs("_prev")).otherwise(F.when(F.col("_sum") > 0, 1.0).otherwise(0.0)),
    )
    n = F.col("months").cast("double")
    exponent = F.when(n < 12, F.lit(1.0) / n).otherwise(F.lit(12.0) / n)
    cagr = F.when(
        (n >= 2) & (F.col("_first") > 0) & (F.col("_last") > 0), F.pow(F.col("_last") / F.nullif(F.col("_first"), F.lit(0.0)), exponent) - 1
    ).otherwise(0.0)
    return stats.select(
        "taxpayer", "window_months", "metric", "months", F.round("mean", digits).alias("mean"), F.round("median", digits).alias("median"),
        F.round(growth, 4).alias("growth"), F.round(F.coalesce("slope", F.lit(0.0)), slope_digits).alias("slope"), F.round(cagr, 4).alias("cagr"),
    )


def annual_cash_flow(history: DataFrame) -> DataFrame:
    """Operating cash flow per taxpayer and year: inflows minus outflows of its months."""
    return history.groupBy("taxpayer", F.year("month").alias("year")).agg(F.sum(F.col("inflows") - F.col("outflows")).alias("operating_cash_flow"))


def valid_years(yearly: DataFrame, assets: str = "assets", revenue: str = "revenue", k: int = 3) -> DataFrame:
    """The last ``k`` years with assets or revenue beyond one peso."""
    from balanza.operators.ordered import top_k

    real = (F.abs(F.coalesce(F.col(assets), F.lit(0))) > 1) | (F.abs(F.coalesce(F.col(revenue), F.lit(0))) > 1)
    return top_k(yearly.filter(real), ["taxpayer"], [F.col("year").desc()], k, "recency")


def month_grid(series: DataFrame, keys=("taxpayer", "metric")) -> DataFrame:
    """Every month from the first to the last of a series, 0 where there is none."""
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min("month").alias("_from"), F.max("month").alias("_to"))
    grid = span.select(*keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("month"))
    return grid.join(series.select(*keys, "month", "amount"), [*keys, "month"], "left").withColumn("amount", F.coalesce("amount", _zero()))


def sync_series(series: DataFrame, leader: str, follower: str) -> DataFrame:
    """Cuts leader and follower at the leader's first positive month and aligns their months.

    Both get the union of their months from there on, 0 where one has none. Without a positive
    month both stay as they are.
    """
    pair = month_grid(series.filter(F.col("metric").isin(leader, follower)))
    per_taxpayer = Window.partitionBy("taxpayer")
    start = F.min(F.when((F.col("metric") == leader) & (F.col("amount") > 0), F.col("month"))).over(per_taxpayer)
    cut = pair.withColumn("_start", start).filter(F.col("_start").isNull() | (F.col("month") >= F.col("_start")))
    wide = cut.groupBy("taxpayer", "month").agg(
        F.first("_start").alias("_start"),
        *[F.sum(F.when(F.col("metric") == m, F.col("amount"))).alias(m) for m in (leader, follower)],
    )
    long = wide.select("taxpayer", "month", "_start", F.col(leader).cast(MONEY).alias(leader), F.col(follower).cast(MONEY).alias(follower)).unpivot(
        ["taxpayer", "month", "_start"], [leader, follower], "metric", "amount"
    )
    return long.filter(F.col("amount").isNotNull() | F.col("_start").isNotNull()).select(
        "taxpayer", "metric", "month", F.coalesce("amount", _zero()).alias("amount")
    )


def receivables(records: DataFrame) -> DataFrame:
    """Running totals per taxpayer and side next to the period amounts (one row per start date)."""
    base = records.groupBy("taxpayer", "side", "start_date").agg(F.sum("metric").alias("non_cumulative"))
    w = Window.partitionBy("taxpayer", "side").orderBy("start_date").rowsBetween(Window.unboundedPreceding, 0)
    return base.withColumn("cumulative", F.sum("non_cumulative").over(w))


# Positions from the newest month looked at for headcount.
HEADCOUNT_OFFSETS = {1: 0, 3: 2, 6: 5, 9: 8, 12: 11, 24: 23}


def headcount_trend(monthly: DataFrame) -> DataFrame:
    """Headcount at look-back positions, difference to the next older one, and a trend word."""
    newest = Window.partitionBy("taxpayer").orderBy(F.col("month").desc())
    placed = monthly.withColumn("_back", F.row_number().over(newest) - 1)
    wide = placed.groupBy("taxpayer").agg(
        *[F.max(F.when(F.col("_back") == off, F.col("total"))).alias(f"_v{m}") for m, off in HEADCOUNT_OFFSETS.items()]
    )
    marks = list(HEADCOUNT_OFFSETS)
    rows = []
    for i, m in enumerate(marks):
        now = F.col(f"_v{m}")
        older = F.col(f"_v{marks[i + 1]}") if i + 1 < len(marks) else F.lit(None).cast("bigint")
        diff = now - older
        word = (
            F.when(older.isNull(), F.lit("Sin datos previos")).when(diff > 0, F.lit("Aumentó")).when(diff < 0, F.lit("Disminuyó")).otherwise(F.lit("Constante"))
        )
        rows.append(F.struct(F.lit(m).alias("months_back"), now.alias("total"), F.coalesce(diff, F.lit(0)).alias("difference"), word.alias("trend")))
    return wide.select("taxpayer", F.explode(F.array(*rows)).alias("r")).select("taxpayer", "r.*").filter(F.col("total").isNotNull())
