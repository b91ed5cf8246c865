"""Monthly series, statistics, forecasts, and their report matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.operators import forecast, reports, series as S
from balanza.queries.registry import AS_OF, INV, MONTHLY, TX, query, with_ctes
from balanza.sources import adapters as A


def monthly(spark, d):
    return A.monthly(A.invoices(spark, d), A.movements(spark, d), A.table(spark, d, "supplier"))


def history(spark, d):
    """The wide history, with sales split by payment type."""
    by_type = A.invoices(spark, d).groupBy(
        "taxpayer", F.concat(F.lit("revenue_"), F.lower("pay_type")).alias("metric"), F.trunc("issued", "month").alias("month")
    ).agg(F.sum("total").alias("amount"), F.count(F.lit(1)).alias("n"))
    return S.raw_history(monthly(spark, d).unionByName(by_type))


_FEED = """feed AS (SELECT s_nationkey AS taxpayer, date_trunc('month', posted)::DATE AS month, CASE kind WHEN 'abono' THEN 'inflow' WHEN 'cargo' THEN 'outflow' ELSE 'total' END AS type,
 CASE WHEN line_no = 1 THEN NULL WHEN line_no = 2 THEN 0 ELSE amount END AS mxn_amount, amount + 1 AS amount, quantity AS transactions, mov_id AS seq FROM tx JOIN supplier ON doc_id = s_suppkey),
val AS (SELECT *, coalesce(nullif(mxn_amount, 0), amount, 0) AS v FROM feed)"""


def _feed(spark, d):
    rows = A.movements(spark, d).join(A.table(spark, d, "supplier"), F.col("doc_id") == F.col("s_suppkey"))
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.select(
        F.col("s_nationkey").alias("taxpayer"), F.trunc("posted", "month").alias("month"),
        F.when(F.col("kind") == "abono", "inflow").when(F.col("kind") == "cargo", "outflow").otherwise("total").alias("type"),
        F.when(F.col("line_no") == 2, zero).when(F.col("line_no") != 1, F.col("amount")).alias("mxn_amount"),
        (F.col("amount") + 1).cast("decimal(18,2)").alias("amount"), F.col("quantity").alias("transactions"), F.col("mov_id").alias("seq"),
    )


@query("monthly_cashflow", with_ctes(TX, _FEED) + """
SELECT taxpayer, month::VARCHAR AS month, CAST(sum(CASE WHEN type = 'inflow' THEN v ELSE 0 END) AS DOUBLE) AS inflow, CAST(sum(CASE WHEN type = 'outflow' THEN v ELSE 0 END) AS DOUBLE) AS outflow,
 sum(CASE WHEN type = 'inflow' THEN transactions ELSE 0 END)::BIGINT AS inflow_count, sum(CASE WHEN type = 'outflow' THEN transactions ELSE 0 END)::BIGINT AS outflow_count FROM val GROUP BY ALL""")
def monthly_cashflow(spark, d):
    return S.monthly_cashflow(_feed(spark, d))


@query("monthly_last", with_ctes(TX, _FEED) + "SELECT taxpayer, month::VARCHAR AS month, CAST(arg_max(v, seq) AS DOUBLE) AS amount, arg_max(transactions, seq)::BIGINT AS n FROM val GROUP BY ALL")
def monthly_last(spark, d):
    return S.monthly_last(_feed(spark, d))


@query("sales_pue_ppd", with_ctes(INV) + """
SELECT taxpayer, date_trunc('month', issued)::DATE::VARCHAR AS month, CAST(sum(CASE WHEN pay_type = 'PUE' THEN total ELSE 0 END) AS DOUBLE) AS pue, CAST(sum(CASE WHEN pay_type = 'PPD' AND status <> 'open' THEN total ELSE 0 END) AS DOUBLE) AS ppd FROM inv GROUP BY ALL""")
def sales_pue_ppd(spark, d):
    inv = A.invoices(spark, d)
    kind = F.when(F.col("pay_type") == "PUE", "pago pue").when(F.col("status") != "open", "x-PPD-y").otherwise("otro")
    feed = inv.select("taxpayer", F.trunc("issued", "month").alias("month"), kind.alias("payment_type"), F.col("total").alias("mxn_amount"), F.col("total").alias("amount"))
    return S.sales_by_payment_type(feed)


WIDE = """wide AS (SELECT taxpayer, month, sum(CASE WHEN metric = 'revenue' THEN amount ELSE 0 END) AS revenue, sum(CASE WHEN metric = 'expenditure' THEN amount ELSE 0 END) AS expenses,
 sum(CASE WHEN metric = 'inflow' THEN amount ELSE 0 END) AS inflows, sum(CASE WHEN metric = 'outflow' THEN amount ELSE 0 END) AS outflows,
 sum(CASE WHEN metric = 'inflow' THEN n ELSE 0 END)::BIGINT AS inflows_count, sum(CASE WHEN metric = 'outflow' THEN n ELSE 0 END)::BIGINT AS outflows_count,
 count(*) FILTER (metric IN ('inflow', 'outflow')) AS cash_rows FROM monthly GROUP BY ALL)"""


@query("raw_history", with_ctes(INV, TX, MONTHLY, WIDE) + """
, t AS (SELECT taxpayer, date_trunc('month', issued)::DATE AS month, sum(CASE WHEN pay_type = 'PUE' THEN total ELSE 0 END) AS pue, sum(CASE WHEN pay_type = 'PPD' THEN total ELSE 0 END) AS ppd FROM inv GROUP BY ALL)
SELECT w.taxpayer, w.month::VARCHAR AS month, CAST(revenue AS DOUBLE) AS revenue, CAST(coalesce(pue, 0) AS DOUBLE) AS revenue_pue, CAST(coalesce(ppd, 0) AS DOUBLE) AS revenue_ppd, CAST(expenses AS DOUBLE) AS expenses,
 CAST(inflows AS DOUBLE) AS inflows, CAST(outflows AS DOUBLE) AS outflows, CAST(inflows - outflows AS DOUBLE) AS nfcf, inflows_count, outflows_count FROM wide w LEFT JOIN t ON w.taxpayer = t.taxpayer AND w.month = t.month""")
def raw_history(spark, d):
    return history(spark, d).drop("cash_rows")


STATS = """hist AS (SELECT taxpayer, month, revenue, expenses, inflows, outflows, inflows - outflows AS nfcf, row_number() OVER (PARTITION BY taxpayer ORDER BY month DESC) AS back, count(*) OVER (PARTITION BY taxpayer) AS n
 FROM wide WHERE cash_rows > 0 AND month <> DATE '2001-08-01'),
longer AS (SELECT taxpayer, back, n, 'revenue' AS metric, revenue AS v FROM hist UNION ALL SELECT taxpayer, back, n, 'expenses', expenses FROM hist UNION ALL SELECT taxpayer, back, n, 'inflows', inflows FROM hist
 UNION ALL SELECT taxpayer, back, n, 'outflows', outflows FROM hist UNION ALL SELECT taxpayer, back, n, 'nfcf', nfcf FROM hist),
win AS (SELECT l.*, w AS window_months, least(w, n) AS len FROM longer l, (VALUES (24), (12), (9), (6), (3)) x(w)),
agg AS (SELECT taxpayer, window_months, metric, max(len) AS months, max(n) AS n, sum(v) FILTER (back <= len)::DOUBLE AS s, coalesce(sum(v) FILTER (back > len AND back <= 2 * len AND n >= 2 * len), 0)::DOUBLE AS p,
 median(v::DOUBLE) FILTER (back <= len) AS med, count(*) FILTER (back <= len) AS k, sum(len - back) FILTER (back <= len) AS sx, sum((len - back) * (len - back)) FILTER (back <= len) AS sxx,
 sum(CAST(v * 100 AS HUGEINT)) FILTER (back <= len) AS sy, sum(CAST(v * 100 AS HUGEINT) * (len - back)) FILTER (back <= len) AS sxy, arg_max(v::DOUBLE, back) FILTER (back <= len) AS a, arg_min(v::DOUBLE, back) FILTER (back <= len) AS b FROM win GROUP BY ALL),
stats AS (SELECT taxpayer, window_months, metric, months, round(s / months, 6) AS mean, round(med, 6) AS median,
 round(CASE WHEN n >= 2 * months THEN CASE WHEN p <> 0 THEN (s - p) / abs(p) WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END, 4) AS growth, round(coalesce(CASE WHEN k * sxx - sx * sx <> 0 THEN (k * sxy - sx * sy)::DOUBLE / ((k * sxx - sx * sx) * 100)::DOUBLE END, 0), 6) AS slope,
 round(CASE WHEN months >= 2 AND a > 0 AND b > 0 THEN pow(b / a, CASE WHEN months < 12 THEN 1.0::DOUBLE / months ELSE 12.0::DOUBLE / months END) - 1 ELSE 0 END, 4) AS cagr FROM agg)"""


def stats(spark, d):
    return S.window_stats(history(spark, d), AS_OF, digits=6, slope_digits=6)


@query("window_stats", with_ctes(INV, TX, MONTHLY, WIDE, STATS) + "SELECT taxpayer, window_months, metric, months, mean, median, growth, slope, cagr FROM stats")
def window_stats(spark, d):
    return stats(spark, d)


@query("billing_matrix", with_ctes(INV, TX, MONTHLY, WIDE, STATS) + """
, u AS (SELECT taxpayer, metric, window_months, unnest(['mean', 'median', 'growth', 'slope', 'cagr']) AS stat, unnest([mean, median, growth, slope, cagr]) AS v FROM stats)
SELECT taxpayer, metric, stat, max(v) FILTER (window_months = 24) AS "24", max(v) FILTER (window_months = 12) AS "12", max(v) FILTER (window_months = 9) AS "9", max(v) FILTER (window_months = 6) AS "6", max(v) FILTER (window_months = 3) AS "3" FROM u GROUP BY ALL""")
def billing_matrix(spark, d):
    return reports.unpivot_pivot(stats(spark, d), ["taxpayer", "metric"], "window_months", S.WINDOWS, ["mean", "median", "growth", "slope", "cagr"], "stat")


@query("annual_cash_flow", with_ctes(INV, TX, MONTHLY, WIDE) + "SELECT taxpayer, year(month) AS year, CAST(sum(inflows - outflows) AS DOUBLE) AS operating_cash_flow FROM wide GROUP BY ALL")
def annual_cash_flow(spark, d):
    return S.annual_cash_flow(history(spark, d))


@query("valid_years", with_ctes(INV, TX, MONTHLY, WIDE) + """
, y AS (SELECT taxpayer, year(month) AS year, sum(CASE WHEN year(month) = 2000 THEN 0 ELSE inflows END) AS assets, sum(CASE WHEN year(month) IN (1999, 2000) THEN 0.5 ELSE revenue END) / 100 AS revenue FROM wide GROUP BY ALL)
SELECT taxpayer, year, rank FROM (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY year DESC) AS rank FROM y WHERE abs(assets) > 1 OR abs(revenue) > 1) WHERE rank <= 3""")
def valid_years(spark, d):
    y = F.year("month")
    yearly = history(spark, d).groupBy("taxpayer", y.alias("year")).agg(
        F.sum(F.when(y == 2000, 0).otherwise(F.col("inflows"))).alias("assets"),
        (F.sum(F.when(y.isin(1999, 2000), F.lit(0.5)).otherwise(F.col("revenue").cast("double"))) / 100).alias("revenue"),
    )
    return S.valid_years(yearly).select("taxpayer", "year", F.col("recency").alias("rank"))


GRID = """span AS (SELECT taxpayer, metric, min(month) AS f, max(month) AS t FROM monthly GROUP BY ALL),
grid AS (SELECT s.taxpayer, s.metric, m::DATE AS month, coalesce(amount, 0) AS amount FROM (SELECT taxpayer, metric, unnest(generate_series(f::TIMESTAMP, t::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM span) s
 LEFT JOIN monthly q ON s.taxpayer = q.taxpayer AND s.metric = q.metric AND s.m = q.month)"""


@query("month_grid", with_ctes(INV, TX, MONTHLY, GRID) + "SELECT taxpayer, metric, month::VARCHAR AS month, CAST(amount AS DOUBLE) AS amount FROM grid")
def month_grid(spark, d):
    return S.month_grid(monthly(spark, d))


@query("sync_series", with_ctes(INV, TX, MONTHLY, GRID) + """
, st AS (SELECT taxpayer, min(month) AS s FROM grid WHERE metric = 'expenditure' AND amount > 0 GROUP BY ALL),
cut AS (SELECT g.* FROM grid g LEFT JOIN st ON g.taxpayer = st.taxpayer WHERE metric IN ('expenditure', 'outflow') AND (s IS NULL OR month >= s)),
u AS (SELECT DISTINCT c.taxpayer, month, m AS metric, s FROM cut c LEFT JOIN st ON c.taxpayer = st.taxpayer, (VALUES ('expenditure'), ('outflow')) x(m))
SELECT u.taxpayer, u.metric, u.month::VARCHAR AS month, CAST(coalesce(c.amount, 0) AS DOUBLE) AS amount FROM u LEFT JOIN cut c ON u.taxpayer = c.taxpayer AND u.metric = c.metric AND u.month = c.month WHERE c.amount IS NOT NULL OR s IS NOT NULL""")
def sync_series(spark, d):
    return S.sync_series(monthly(spark, d), "expenditure", "outflow")


FIT = """ix AS (SELECT *, (row_number() OVER (PARTITION BY taxpayer, metric ORDER BY month) - 1) AS x, count(*) OVER (PARTITION BY taxpayer, metric) AS n, amount::DOUBLE AS y FROM grid),
fit0 AS (SELECT taxpayer, metric, max(n) AS n, max(month) AS last_month, sum(x) AS sx, sum(x * x) AS sxx, sum(CAST(amount * 100 AS HUGEINT)) AS sy, sum(CAST(amount * 100 AS HUGEINT) * x) AS sxy, avg(y) FILTER (x >= n - 3) AS r, avg(y) FILTER (x < 3) AS e, sum(amount) FILTER (x >= n - 12)::DOUBLE AS s FROM ix WHERE n >= 3 GROUP BY ALL),
fit1 AS (SELECT *, (n * sxy - sx * sy)::DOUBLE / ((n * sxx - sx * sx) * 100)::DOUBLE AS m FROM fit0),
fit AS (SELECT *, (sy::DOUBLE / 100.0::DOUBLE - m * sx::DOUBLE) / n::DOUBLE AS c FROM fit1),
sd AS (SELECT i.taxpayer, i.metric, stddev_pop(y - (m * x + c)) AS std FROM ix i JOIN fit f ON i.taxpayer = f.taxpayer AND i.metric = f.metric GROUP BY ALL),
pred AS (SELECT f.*, std, h AS step, m * (n + h - 1) + c AS predicted, CASE WHEN n >= 12 THEN s ELSE s * (12.0::DOUBLE / n) END AS last12, CASE WHEN n >= 6 AND e > 0 THEN (r - e) / e ELSE 0 END AS hg
 FROM fit f JOIN sd ON f.taxpayer = sd.taxpayer AND f.metric = sd.metric, (SELECT unnest(range(1, 13)) AS h) q),
pts AS (SELECT taxpayer, metric, step, (last_month + to_months(CAST(step AS INT)))::DATE AS month, last12, hg, 'realistic' AS scenario, greatest(0, predicted) AS value FROM pred
 UNION ALL SELECT taxpayer, metric, step, (last_month + to_months(CAST(step AS INT)))::DATE, last12, hg, 'optimistic', greatest(0, greatest(0, predicted) + std) FROM pred
 UNION ALL SELECT taxpayer, metric, step, (last_month + to_months(CAST(step AS INT)))::DATE, last12, hg, 'pessimistic', greatest(0, greatest(0, predicted) - std) FROM pred)"""


def _grid(spark, d):
    return S.month_grid(monthly(spark, d))


def _points(spark, d):
    grid = _grid(spark, d)
    return forecast.scenarios(forecast.forecast_linear(grid), forecast.series_facts(grid))


@query("forecast_linear", with_ctes(INV, TX, MONTHLY, GRID, FIT) + "SELECT taxpayer, metric, 'linear' AS model, step, round(predicted, 3) AS predicted, round(std, 3) AS std FROM pred")
def forecast_linear(spark, d):
    out = forecast.forecast_linear(_grid(spark, d))
    return out.withColumns({"predicted": F.round("predicted", 3), "std": F.round("std", 3)})


@query("forecast_scenarios", with_ctes(INV, TX, MONTHLY, GRID, FIT) + "SELECT taxpayer, metric, 'linear' AS model, step, month::VARCHAR AS month, scenario, round(value, 3) AS value FROM pts")
def forecast_scenarios(spark, d):
    return _points(spark, d).withColumn("value", F.round("value", 3))


@query("forecast_growth", with_ctes(INV, TX, MONTHLY, GRID, FIT) + """
SELECT taxpayer, metric, 'linear' AS model, scenario, round(max(hg), 4) AS history_growth, round(CASE WHEN max(last12) > 0 THEN (sum(value) - max(last12)) / max(last12) ELSE 0 END, 4) AS comparison,
 round(CASE WHEN arg_min(value, step) > 1 THEN (arg_max(value, step) - arg_min(value, step)) / arg_min(value, step) ELSE 0 END, 4) AS trend FROM pts GROUP BY ALL""")
def forecast_growth(spark, d):
    grid = _grid(spark, d)
    return forecast.scenario_growth(_points(spark, d), forecast.series_facts(grid))


@query("forecast_nfcf", with_ctes(INV, TX, MONTHLY, GRID, FIT) + """
SELECT i.taxpayer, 'nfcf' AS metric, 'linear' AS model, i.step, i.month::VARCHAR AS month, i.scenario, round(round(i.value, 2) - round(o.value, 2), 2) AS value FROM pts i JOIN pts o ON i.taxpayer = o.taxpayer AND i.step = o.step AND i.metric = 'inflow' AND o.metric = 'outflow'
 AND o.scenario = CASE i.scenario WHEN 'optimistic' THEN 'pessimistic' WHEN 'pessimistic' THEN 'optimistic' ELSE 'realistic' END""")
def forecast_nfcf(spark, d):
    return forecast.derive_nfcf(_points(spark, d))


def _smoothing_sql(name: str, model: str, source: str, season: int, phi: float, weights) -> str:
    """CTEs that fit the smoothing model month by month for given weights: ``name`` (keys, model, step, predicted, std)."""
    k = 2 + max(season - 1, 0)
    a, b, c = [f"{w}::DOUBLE" for w in (*weights, 0.0)[:3]]
    unit = ["[" + ", ".join("1.0::DOUBLE" if i == at else "0.0::DOUBLE" for i in range(k + 1)) + "]" for at in (*range(k), -1)]
    year = "[" + ", ".join(unit[2 : k] + [unit[-1]]) + "]" if season else f"[{unit[-1]}]"
    cols = f"range(1, {k + 2})"
    rest = f"list_slice(yr, 2, {season})" if season else "[]"
    now, alone = ("yr[1][i]", "yr[1]") if season else ("0.0::DOUBLE", "0.0::DOUBLE")
    fresh = f"[{c} * (d[i] - ahead[i]) + (1 - {c}) * {now} FOR i IN {cols}]"
    months = f"{name}_y"
    both = "s.taxpayer = q.taxpayer AND s.metric = q.metric"
    return f"""{months} AS (SELECT taxpayer, metric, x, n, y FROM (SELECT *, row_number() OVER (PARTITION BY taxpayer, metric ORDER BY month) - 1 AS x,
  count(*) OVER (PARTITION BY taxpayer, metric) AS n, amount::DOUBLE AS y FROM {source}) WHERE n >= {2 * season if season else 3}),
{name}_r(taxpayer, metric, t, lv, tr, yr, pred) AS (
 SELECT taxpayer, metric, 0::BIGINT, {unit[0]}, {unit[1]}, {year}, {unit[-1]} FROM {months} WHERE x = 0
 UNION ALL SELECT taxpayer, metric, t + 1, new, [{b} * (new[i] - lv[i]) + (1 - {b}) * ({phi}::DOUBLE * tr[i]) FOR i IN {cols}], {f"list_concat({rest}, [{fresh}])" if season else "yr"},
  [ahead[i] + {now} FOR i IN {cols}] FROM (
  SELECT *, [{a} * (d[i] - {now}) + (1 - {a}) * ahead[i] FOR i IN {cols}] AS new FROM (
   SELECT s.*, [s.lv[i] + {phi}::DOUBLE * s.tr[i] FOR i IN {cols}] AS ahead, [CASE WHEN i = {k + 1} THEN q.y ELSE 0.0::DOUBLE END FOR i IN {cols}] AS d
   FROM {name}_r s JOIN {months} q ON {both} AND q.x = s.t))),
{name}_o AS (SELECT s.taxpayer, s.metric, [CASE WHEN i = {k + 1} THEN q.y - s.pred[i] ELSE s.pred[i] END FOR i IN {cols}] AS v FROM {name}_r s JOIN {months} q ON {both} AND q.x = s.t - 1),
{name}_g AS (SELECT taxpayer, metric, i, j, sum(v[i] * v[j]) AS v FROM {name}_o, (SELECT unnest(range(1, {k + 1})) AS i) a, (SELECT unnest({cols}) AS j) b GROUP BY ALL),
{name}_e(taxpayer, metric, p, m) AS (
 SELECT taxpayer, metric, 1::BIGINT, list(line ORDER BY i) FROM (SELECT taxpayer, metric, i, list(v ORDER BY j) AS line FROM {name}_g GROUP BY ALL) GROUP BY ALL
 UNION ALL SELECT taxpayer, metric, p + 1, [CASE WHEN i = p THEN m[i] ELSE [m[i][j] - (m[i][p] * CASE WHEN m[p][p] > 1e-10 THEN 1.0::DOUBLE / m[p][p] ELSE 0 END) * m[p][j] FOR j IN {cols}] END FOR i IN range(1, {k + 1})]
 FROM {name}_e WHERE p <= {k}),
{name}_s AS (SELECT taxpayer, metric, [CASE WHEN m[i][i] > 1e-10 THEN m[i][{k + 1}] / m[i][i] ELSE 0 END FOR i IN range(1, {k + 1})] AS st FROM {name}_e WHERE p = {k + 1}),
{name}_w(taxpayer, metric, t, lv, tr, yr, err) AS (
 SELECT taxpayer, metric, 0::BIGINT, st[1], st[2], {f"list_concat(list_slice(st, 3, {k}), [0.0::DOUBLE])" if season else "[0.0::DOUBLE]"}, NULL::DOUBLE FROM {name}_s
 UNION ALL SELECT taxpayer, metric, t + 1, new, {b} * (new - lv) + (1 - {b}) * ({phi}::DOUBLE * tr), {f"list_concat({rest}, [{c} * (y - ahead) + (1 - {c}) * {alone}])" if season else "yr"}, y - (ahead + {alone}) FROM (
  SELECT *, {a} * (y - {alone}) + (1 - {a}) * ahead AS new FROM (SELECT s.*, q.y, s.lv + {phi}::DOUBLE * s.tr AS ahead FROM {name}_w s JOIN {months} q ON {both} AND q.x = s.t))),
{name}_d AS (SELECT taxpayer, metric, stddev_pop(err) AS std, max(t) AS n FROM {name}_w GROUP BY ALL),
{name} AS (SELECT s.taxpayer, s.metric, '{model}' AS model, h AS step, s.lv + s.tr * list_sum([pow({phi}::DOUBLE, i) FOR i IN range(1, h + 1)]) + {f"s.yr[(h - 1) % {season} + 1]" if season else "0"} AS predicted, std
 FROM {name}_w s JOIN {name}_d q ON {both} AND s.t = q.n, (SELECT unnest(range(1, 13)) AS h) u)"""


# Weights that the queries with an oracle are given; the others search them.
_DAMPED, _SEASONAL = (0.4, 0.2), (0.3, 0.1, 0.2)


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + with_ctes(*ctes).removeprefix("WITH ")


def _whole(df):
    """In whole units: both engines add doubles in their own order."""
    return df.withColumns({"predicted": F.round("predicted", 0), "std": F.round("std", 0)})


_WHOLE = "SELECT taxpayer, metric, model, step, round(predicted, 0) AS predicted, round(std, 0) AS std FROM "


@query("forecast_damped_given", _recursive(INV, TX, MONTHLY, GRID, _smoothing_sql("dp", "exponential", "grid", 0, 0.32, _DAMPED)) + _WHOLE + "dp")
def forecast_damped_given(spark, d):
    return _whole(forecast.forecast_damped(_grid(spark, d), weights=_DAMPED))


@query("forecast_seasonal_given", _recursive(INV, TX, MONTHLY, GRID, _smoothing_sql("sn", "seasonal", "grid", 12, 0.90, _SEASONAL)) + _WHOLE + "sn")
def forecast_seasonal_given(spark, d):
    return _whole(forecast.forecast_seasonal(_grid(spark, d), weights=_SEASONAL))


@query("forecast_status", with_ctes(INV, TX, MONTHLY) + "SELECT taxpayer, metric, count(*) AS n, CASE WHEN count(*) < 3 THEN 'short' WHEN count(*) < 24 THEN 'no_season' ELSE 'full' END AS status FROM monthly GROUP BY ALL")
def forecast_status(spark, d):
    return forecast.forecast_status(monthly(spark, d))


@query("forecast_damped")
def forecast_damped(spark, d):
    return forecast.forecast_damped(_grid(spark, d))


@query("forecast_seasonal")
def forecast_seasonal(spark, d):
    return forecast.forecast_seasonal(_grid(spark, d))


@query("forecast_all")
def forecast_all(spark, d):
    return forecast.forecast_all(monthly(spark, d))


@query("scenario_matrix", with_ctes(INV, TX, MONTHLY, GRID, FIT) + """
, past AS (SELECT taxpayer, metric, concat('h', lpad((12 - (n - 1 - x))::INT::VARCHAR, 2, '0')) AS k, y AS v FROM ix WHERE x >= n - 12 AND n >= 3),
future AS (SELECT taxpayer, metric, scenario, concat('p', lpad(step::VARCHAR, 2, '0')) AS k, value AS v FROM pts),
sc AS (SELECT DISTINCT taxpayer, metric, scenario FROM pts),
everything AS (SELECT s.taxpayer, s.metric, s.scenario, p.k, p.v FROM sc s JOIN past p ON s.taxpayer = p.taxpayer AND s.metric = p.metric UNION ALL SELECT * FROM future)
SELECT taxpayer, metric, 'linear' AS model, scenario, """ + ", ".join(
    [f"round(coalesce(max(v) FILTER (k = 'h{i:02d}'), 0), 3) AS h{i:02d}" for i in range(1, 13)]
    + [f"round(max(v) FILTER (k = 'p{i:02d}'), 3) AS p{i:02d}" for i in range(1, 13)]
) + " FROM everything GROUP BY taxpayer, metric, scenario")
def scenario_matrix(spark, d):
    grid = _grid(spark, d)
    return reports.scenario_matrix(grid, _points(spark, d), digits=3)


@query("headcount_trend", with_ctes(INV) + """
, c AS (SELECT taxpayer, date_trunc('month', issued)::DATE AS month, count(*) AS total FROM inv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY month DESC) - 1 AS back FROM c),
v AS (SELECT taxpayer, CASE back WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 5 THEN 6 WHEN 8 THEN 9 WHEN 11 THEN 12 WHEN 23 THEN 24 END AS months_back, total FROM r WHERE back IN (0, 2, 5, 8, 11, 23)),
n AS (SELECT a.taxpayer, a.months_back, a.total, b.total AS older FROM v a LEFT JOIN v b ON a.taxpayer = b.taxpayer AND b.months_back = CASE a.months_back WHEN 1 THEN 3 WHEN 3 THEN 6 WHEN 6 THEN 9 WHEN 9 THEN 12 WHEN 12 THEN 24 END)
SELECT taxpayer, months_back, total, coalesce(total - older, 0) AS difference, CASE WHEN older IS NULL THEN 'Sin datos previos' WHEN total > older THEN 'Aumentó' WHEN total < older THEN 'Disminuyó' ELSE 'Constante' END AS trend FROM n""")
def headcount_trend(spark, d):
    return S.headcount_trend(A.invoices(spark, d).groupBy("taxpayer", F.trunc("issued", "month").alias("month")).agg(F.count(F.lit(1)).alias("total")))


@query("receivables_cumulative", with_ctes(INV) + """
, b AS (SELECT taxpayer, CASE WHEN status = 'open' THEN 'receivable' ELSE 'payable' END AS side, date_trunc('month', issued)::DATE AS d, sum(total) AS v FROM inv GROUP BY ALL)
SELECT taxpayer, side, d::VARCHAR AS start_date, CAST(v AS DOUBLE) AS non_cumulative, CAST(sum(v) OVER (PARTITION BY taxpayer, side ORDER BY d) AS DOUBLE) AS cumulative FROM b""")
def receivables_cumulative(spark, d):
    rows = A.invoices(spark, d).select(
        "taxpayer", F.when(F.col("status") == "open", "receivable").otherwise("payable").alias("side"), F.trunc("issued", "month").alias("start_date"), F.col("total").alias("metric")
    )
    return S.receivables(rows)
