"""Twelve-month forecasts with scenarios: linear, damped trend, damped seasonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from balanza.functions.plan import settle
from balanza.functions.smoothing import best_weights, smoothed_forecast
from balanza.functions.stats import line

KEYS = ("taxpayer", "metric")
MIN_MONTHS = 3
HORIZON = 12

# Damping of the trend, without and with a season, and the season's length.
DAMPED_PHI, SEASONAL_PHI, SEASON = 0.32, 0.90, 12


def _indexed(series: DataFrame) -> DataFrame:
    """Months numbered from 0, with the number of months; series are one row per month."""
    w = Window.partitionBy(*KEYS)
    return series.withColumns({
        "_x": F.row_number().over(w.orderBy("month")) - 1,
        "_n": F.count(F.lit(1)).over(w),
        "_y": F.col("amount").cast("double"),
    }).filter(F.col("_n") >= MIN_MONTHS)


def series_facts(series: DataFrame) -> DataFrame:
    """Per series: months, last month, growth of the last against the first three months, and the
    sum of the last twelve (scaled up from a shorter history)."""
    rows = _indexed(series)
    recent = F.avg(F.when(F.col("_x") >= F.col("_n") - 3, F.col("_y")))
    early = F.avg(F.when(F.col("_x") < 3, F.col("_y")))
    facts = rows.groupBy(*KEYS).agg(
        F.max("_n").alias("n"), F.max("month").alias("last_month"), recent.alias("_r"), early.alias("_e"),
        F.sum(F.when(F.col("_x") >= F.col("_n") - 12, F.col("amount"))).cast("double").alias("_s"),
    )
    return facts.select(
        *KEYS, "n", "last_month",
        F.when((F.col("n") >= 6) & (F.col("_e") > 0), (F.col("_r") - F.col("_e")) / F.nullif(F.col("_e"), F.lit(0.0))).otherwise(0.0).alias("history_growth"),
        F.when(F.col("n") >= 12, F.col("_s")).otherwise(F.col("_s") * (F.lit(12.0) / F.col("n"))).alias("last_12_sum"),
    )


def forecast_linear(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Least-squares line projected ``horizon`` months: (keys, model, step, predicted, std)."""
    slope, intercept = line(F.col("_x"), F.col("amount"), Window.partitionBy(*KEYS))
    rows = _indexed(series).withColumns({"_m": slope, "_c": intercept})
    fit = rows.groupBy(*KEYS).agg(
        F.first("_n").alias("n"), F.first("_m").alias("_m"), F.first("_c").alias("_c"),
        F.stddev_pop(F.col("_y") - (F.col("_m") * F.col("_x") + F.col("_c"))).alias("std"),
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return fit.select(*KEYS, "n", "_m", "_c", "std", step).select(
        *KEYS, F.lit("linear").alias("model"), "step",
        (F.col("_m") * (F.col("n") + F.col("step") - 1) + F.col("_c")).alias("predicted"), "std",
    )


def _smoothed(series: DataFrame, model: str, season: int, phi: float, min_months: int, horizon: int, weights) -> DataFrame:
    """One row a series with its months as an array, spread over all cores: a fit is work on few bytes."""
    rows = _indexed(series).filter(F.col("_n") >= min_months)
    months = F.transform(F.sort_array(F.collect_list(F.struct("_x", "_y"))), lambda p: p["_y"])
    listed = rows.groupBy(*KEYS).agg(months.alias("_months")).repartition(2 * series.sparkSession.sparkContext.defaultParallelism)
    y = F.col("_months")
    chosen = F.array(*[F.lit(float(x)) for x in weights]) if weights is not None else best_weights(y, phi, season)
    fitted = settle(settle(listed, {"_w": chosen}), {"_f": smoothed_forecast(y, F.col("_w"), phi, season, horizon)})
    return fitted.select(*KEYS, F.lit(model).alias("model"), F.posexplode("_f.predicted").alias("step", "predicted"), F.col("_f.std").alias("std")).withColumn(
        "step", F.col("step") + 1
    )


def forecast_damped(series: DataFrame, horizon: int = HORIZON, weights=None) -> DataFrame:
    """Damped additive trend; ``weights`` (level, trend) are searched unless given."""
    return _smoothed(series, "exponential", 0, DAMPED_PHI, MIN_MONTHS, horizon, weights)


def forecast_seasonal(series: DataFrame, horizon: int = HORIZON, weights=None) -> DataFrame:
    """Damped trend with an additive yearly season; needs two years. ``weights``: level, trend, season."""
    return _smoothed(series, "seasonal", SEASON, SEASONAL_PHI, 2 * SEASON, horizon, weights)


def forecast_status(series: DataFrame) -> DataFrame:
    """(keys, n, status) of every series: ``short`` has no forecast, ``no_season`` none of the seasonal model, others ``full``."""
    n = F.count(F.lit(1))
    status = F.when(F.col("n") < MIN_MONTHS, "short").when(F.col("n") < 2 * SEASON, "no_season").otherwise("full")
    return series.groupBy(*KEYS).agg(n.alias("n")).withColumn("status", status)


def scenarios(predicted: DataFrame, facts: DataFrame) -> DataFrame:
    """Realistic, optimistic and pessimistic values per month: clipped at 0, plus and minus the
    standard error."""
    real = F.greatest(F.lit(0.0), F.col("predicted"))
    cases = F.array(
        F.struct(F.lit("realistic").alias("scenario"), real.alias("value")),
        F.struct(F.lit("optimistic").alias("scenario"), F.greatest(F.lit(0.0), real + F.col("std")).alias("value")),
        F.struct(F.lit("pessimistic").alias("scenario"), F.greatest(F.lit(0.0), real - F.col("std")).alias("value")),
    )
    return predicted.join(facts, list(KEYS)).select(
        *KEYS, "model", "step", F.add_months("last_month", F.col("step")).alias("month"), F.explode(cases).alias("c")
    ).select(*KEYS, "model", "step", "month", "c.scenario", "c.value")


def scenario_growth(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Per scenario: growth against the last twelve months and from its first to its last month."""
    sums = points.groupBy(*KEYS, "model", "scenario").agg(
        F.sum("value").alias("_sum"), F.min_by("value", "step").alias("_first"), F.max_by("value", "step").alias("_last"), F.count(F.lit(1)).alias("_k")
    )
    base = F.col("last_12_sum")
    return sums.join(facts, list(KEYS)).select(
        *KEYS, "model", "scenario", F.round("history_growth", 4).alias("history_growth"),
        F.round(F.when(base > 0, (F.col("_sum") - base) / F.nullif(base, F.lit(0.0))).otherwise(0.0), 4).alias("comparison"),
        F.round(F.when((F.col("_k") >= 2) & (F.col("_first") > 1.0), (F.col("_last") - F.col("_first")) / F.nullif(F.col("_first"), F.lit(0.0))).otherwise(0.0), 4).alias("trend"),
    )


def derive_nfcf(points: DataFrame, inflow: str = "inflow", outflow: str = "outflow") -> DataFrame:
    """Net cash flow per month: best inflow against worst outflow and the other way round.

    One grouped pass; months that only one side has are left out, as are models of one side.
    """
    opposite = F.when(F.col("scenario") == "optimistic", F.lit("pessimistic")).when(F.col("scenario") == "pessimistic", F.lit("optimistic")).otherwise(F.col("scenario"))
    case = F.when(F.col("metric") == outflow, opposite).otherwise(F.col("scenario"))
    rounded = points.filter(F.col("metric").isin(inflow, outflow)).withColumns({"_case": case, "_v": F.round("value", 2)})
    both = rounded.groupBy("taxpayer", "model", "step", F.col("_case").alias("scenario")).agg(
        F.max(F.when(F.col("metric") == inflow, F.col("_v"))).alias("_in"), F.max(F.when(F.col("metric") == outflow, F.col("_v"))).alias("_out"),
        F.max(F.when(F.col("metric") == inflow, F.col("month"))).alias("month"),
    )
    return both.filter(F.col("_in").isNotNull() & F.col("_out").isNotNull()).select(
        "taxpayer", F.lit("nfcf").alias("metric"), "model", "step", "month", "scenario", F.round(F.col("_in") - F.col("_out"), 2).alias("value")
    )


def forecast_all(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Three models for revenue, expenditure, inflow and outflow, cut and aligned in pairs, and the
    derived net cash flow, as one frame."""
    from balanza.operators.series import sync_series

    ready = sync_series(series, "revenue", "inflow").unionByName(sync_series(series, "expenditure", "outflow"))
    predicted = forecast_linear(ready, horizon).unionByName(forecast_damped(ready, horizon)).unionByName(forecast_seasonal(ready, horizon))
    points = scenarios(predicted, series_facts(ready))
    return points.withColumn("value", F.round("value", 2)).unionByName(derive_nfcf(points).select(points.columns))

