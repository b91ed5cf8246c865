"""Hand-worked cases: windows, ratios, forecasts, credit, trees, and streams against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from balanza.operators import credit, forecast, network, ratios, series, tree


def months(spark, values, taxpayer=1, metric="revenue", start="2020-01-01"):
    rows = [(taxpayer, metric, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "taxpayer int, metric string, i int, v double")
    return df.select("taxpayer", "metric", F.add_months(F.lit(start).cast("date"), F.col("i")).alias("month"), F.col("v").cast("decimal(18,2)").alias("amount"), F.lit(1).alias("n"))


def test_window_stats(spark):
    flow = months(spark, [100, 200, 300, 400, 500, 600, 700], metric="inflow")
    hist = series.raw_history(flow)
    got = {(r.window_months, r.metric): r for r in series.window_stats(hist, "2020-07-15").collect()}
    three = got[3, "inflows"]
    assert (three.mean, three.median, three.slope, three.months) == (500.0, 500.0, 100.0, 3)
    assert three.growth == round((1500 - 600) / 600, 4) and three.cagr == round((600 / 400) ** (1 / 3) - 1, 4)
    assert got[24, "inflows"].months == 6 and got[24, "inflows"].growth is None and got[3, "revenue"].growth == 0.0


@pytest.mark.parametrize("n", [2, 3, 5, 6, 12, 23, 24])
def test_linear(spark, n):
    y = np.array([10 + 3 * i + (-1) ** i for i in range(n)], dtype=float)
    out = forecast.forecast_linear(months(spark, y)).orderBy("step").collect()
    if n < 3:
        assert out == []
        return
    m, c = np.polyfit(np.arange(n), y, 1)
    np.testing.assert_allclose([r.predicted for r in out], m * np.arange(n, n + 12) + c, rtol=1e-9)
    assert abs(out[0].std - np.std(y - (m * np.arange(n) + c))) < 1e-6
    assert (forecast.forecast_seasonal(months(spark, y)).count() == 12) == (n >= 24)


def holt(y, a, b, phi, level, trend):
    sse = 0.0
    for v in y:
        ahead = level + phi * trend
        sse += (v - ahead) ** 2
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    return sse, level, trend


def test_damped_fit_is_no_worse_than_a_search(spark):
    rng = np.random.default_rng(4)
    y = 100 + 5 * np.arange(30) + rng.normal(0, 8, 30)
    out = forecast.forecast_damped(months(spark, y)).collect()
    best = min(holt(y, a, b, 0.32, lv, tr)[0] for a in np.linspace(0, 1, 11) for b in np.linspace(0, 1, 11) for lv in np.linspace(80, 120, 9) for tr in np.linspace(-10, 20, 7))
    assert out[0].std ** 2 * len(y) <= best * 1.02 and sorted(r.step for r in out) == list(range(1, 13))


def holt_path(y, a, b, phi, level, trend):
    errors = []
    for v in y:
        ahead = level + phi * trend
        errors.append(v - ahead)
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    return np.array(errors), level, trend


def plain_fit(y, w, phi, season, horizon):
    """The same model month by month: starts by numpy's least squares on the predictions' responses."""
    def run(y, level, trend, year):
        out, year = [], list(year)
        for t, v in enumerate(y):
            ahead, now = level + phi * trend, year[t % season] if season else 0.0
            out.append(ahead + now)
            new = w[0] * (v - now) + (1 - w[0]) * ahead
            level, trend = new, w[1] * (new - level) + (1 - w[1]) * phi * trend
            if season:
                year[t % season] = w[2] * (v - ahead) + (1 - w[2]) * now
        return np.array(out), level, trend, year

    k = 2 + max(season - 1, 0)
    design = np.stack([run(np.zeros(len(y)), *(np.eye(k)[i][:2]), [*np.eye(k)[i][2:], 0.0])[0] for i in range(k)], axis=1)
    free = run(y, 0.0, 0.0, [0.0] * season)[0]
    start = np.linalg.lstsq(design, y - free, rcond=None)[0]
    out, level, trend, year = run(y, start[0], start[1], [*start[2:], 0.0])
    sums = np.cumsum([phi**h for h in range(1, horizon + 1)])
    ahead = [level + s * trend + (year[(len(y) + h) % season] if season else 0.0) for h, s in enumerate(sums)]
    return ahead, np.std(y - out), np.sum((y - out) ** 2)


@pytest.mark.parametrize("w", [(0.4, 0.2, 0.3), (0.0, 0.5, 0.0), (1.0, 0.0, 0.0), (0.9, 0.7, 1.0), (0.05, 0.0, 0.6)])
def test_given_weights(spark, w):
    rng = np.random.default_rng(1)
    y = np.round(500 + 3 * np.arange(31) + 40 * np.sin(np.arange(31)) + rng.normal(0, 9, 31), 2)
    for season, phi, fit in ((0, 0.32, forecast.forecast_damped), (12, 0.90, forecast.forecast_seasonal)):
        own = w if season else w[:2]
        out = fit(months(spark, y), weights=own).orderBy("step").collect()
        ahead, std, _ = plain_fit(y, own, phi, season, 12)
        np.testing.assert_allclose([r.predicted for r in out], ahead, rtol=1e-5)
        assert abs(out[0].std - std) < 1e-4


def test_the_search_beats_random_weights(spark):
    rng = np.random.default_rng(8)
    for y in (np.round(300 + rng.normal(0, 30, 26), 2), np.round(100 * np.exp(np.arange(40) / 20), 2), np.repeat([5.0, 90.0], 15)):
        found = forecast.forecast_seasonal(months(spark, y)).first().std ** 2 * len(y)
        others = [plain_fit(y, rng.random(3), 0.90, 12, 1)[2] for _ in range(60)]
        assert found <= min(others) * 1.001 + 1e-6


def test_short_and_constant_series(spark):
    assert forecast.forecast_damped(months(spark, [4.0, 5.0])).collect() == []
    flat = forecast.forecast_seasonal(months(spark, [7.0] * 24)).collect()
    np.testing.assert_allclose([r.predicted for r in flat], [7.0] * 12, atol=1e-6)
    status = forecast.forecast_status(months(spark, [1.0, 2.0]).unionByName(months(spark, [1.0] * 5, metric="m")).unionByName(months(spark, [1.0] * 24, metric="z")))
    assert sorted((r.n, r.status) for r in status.collect()) == [(2, "short"), (5, "no_season"), (24, "full")]


def test_seasonal_finds_the_season(spark):
    season = np.array([0, 5, 9, 5, 0, -5, -9, -5, 0, 3, 6, 3], dtype=float)
    out = forecast.forecast_seasonal(months(spark, np.tile(season, 3) + 100)).orderBy("step").collect()
    np.testing.assert_allclose([r.predicted for r in out], season + 100, atol=0.05)
    assert out[0].std < 0.05


def test_nfcf_and_scenarios(spark):
    both = months(spark, [10, 20, 30, 40], metric="inflow").unionByName(months(spark, [40, 30, 20, 10], metric="outflow"))
    pts = forecast.scenarios(forecast.forecast_linear(both), forecast.series_facts(both))
    net = {(r.step, r.scenario): r.value for r in forecast.derive_nfcf(pts).collect()}
    assert net[1, "realistic"] == 50.0 and net[12, "realistic"] == 160.0 and len(net) == 36
    assert min(r.value for r in pts.collect()) >= 0


def test_ratios(spark):
    values = {"assets": 1000, "liabilities": 400, "equity": 600, "current_assets": 500, "current_liabilities": 250, "inventory": 100, "cash_and_equivalents": 50, "revenue": 2000,
              "net_profit": 0, "net_loss": 120, "ebit_profit": 200, "ebt_profit": 0, "cogs": -800, "accounts_receivable": 100, "retained_earnings": 300, "interest_expense": 0}
    df = spark.createDataFrame([(1, 2023, k, float(v)) for k, v in values.items()], "taxpayer int, year int, account string, amount double")
    r = ratios.ratios(ratios.year_inputs(df)).first()
    assert (r.net_income, r.taxes, r.ebt, r.nopat) == (-120.0, 120.0, 0.0, 80.0)
    assert (r.current_ratio, r.quick_ratio, r.cash_ratio, r.leverage, r.debt_ratio) == (2.0, 1.6, 0.2, 0.67, 0.4)
    assert r.interest_coverage == 0.0 and r.dio == 45.6 and r.roa == -0.12
    assert r.altman_z == round(1.2 * 0.25 + 1.4 * 0.3 + 3.3 * 0.2 + 0.6 * 1.5 + 2.0, 2)


def test_tree(spark):
    text = '{"data":[{"category":"Activo","2023":0,"children":[{"category":"Activo a corto plazo","2023":{"Total":5},"children":[{"category":"Clientes","2023":7}]},{"category":"Activo","2023":9}]}]}'
    df = spark.sql(f"SELECT 1 taxpayer, 'balance' statement, parse_json('{text}') tree")
    flat = tree.flatten_tree(df, ["taxpayer", "statement"])
    assert sorted((r.depth, tuple(r.place), r.amount) for r in flat.collect()) == [(0, (0,), 0.0), (1, (0, 0), 5.0), (1, (0, 1), 9.0), (2, (0, 0, 0), 7.0)]
    got = {r.account: r.amount for r in tree.account_values(flat).collect()}
    assert got == {"assets": 9.0, "current_assets": 5.0, "accounts_receivable": 7.0}
    cut = tree.flatten_tree(df, ["taxpayer"], max_depth=1)
    assert {r.category for r in cut.filter("has_more").collect()} == {"Activo a corto plazo"}


def test_credit(spark):
    rows = [(1, 10, "6280", 1000.0, "2024-01-01", 400, None, 50.0), (1, 11, "1", 3000.0, None, 0, 30.0, 0.0)]
    raw = spark.createDataFrame(rows, "report_id int, line_id int, code string, b double, o string, term_days int, p double, d double").select(
        "report_id", "line_id", "code", F.col("b").cast("decimal(18,2)").alias("balance"), F.col("b").cast("decimal(18,2)").alias("initial_balance"), F.col("o").cast("date").alias("opened"), "term_days",
        F.col("p").cast("decimal(18,2)").alias("stated_past_due"), F.lit(None).cast("string").alias("closed"), F.lit("2025-01-01").cast("date").alias("report_date"),
        *[F.col("d").cast("decimal(18,2)").alias(f"due_{b}") if b == "1_29" else F.lit(0).cast("decimal(18,2)").alias(f"due_{b}") for b in credit.PAST_DUE_BUCKETS],
    )
    lines = {r.line_id: r for r in credit.credit_lines(raw).collect()}
    assert lines[10].days_left == 34 and lines[10].weighted_days == 8.0 and abs(lines[10].monthly_payment - 1000 / (34 / 30.4)) < 1e-9
    assert float(lines[10].past_due) == 50 and float(lines[11].past_due) == 30 and lines[11].monthly_payment == 3000
    total = credit.credit_summary(credit.credit_lines(raw)).first()
    assert total.term_years == 0.02 and float(total.open_initial) == 4000


def test_sync(spark):
    lead = months(spark, [0, 0, 5, 6], metric="revenue")
    follow = months(spark, [1, 2, 3], metric="inflow", start="2020-02-01")
    got = {(r.metric, str(r.month)): float(r.amount) for r in series.sync_series(lead.unionByName(follow), "revenue", "inflow").collect()}
    assert got == {("revenue", "2020-03-01"): 5, ("revenue", "2020-04-01"): 6, ("inflow", "2020-03-01"): 2, ("inflow", "2020-04-01"): 3}


def test_blacklist_newest(spark):
    inv = spark.createDataFrame([(1, 2, "issued", i, f"2024-01-0{i}", 10.0 * i) for i in range(1, 5)], "taxpayer int, counterparty int, side string, invoice_id int, d string, t double").select(
        "taxpayer", "counterparty", "side", "invoice_id", F.col("d").cast("date").alias("issued"), F.col("t").cast("decimal(18,2)").alias("total"))
    listed = spark.createDataFrame([(1, 2, "issued", "x")], "taxpayer int, counterparty int, side string, name string")
    assert float(network.blacklist_enrich(listed, inv).first().amount) == 100
    assert float(network.blacklist_enrich(listed, inv, newest=2).first().amount) == 70


def test_ratio_matrix_has_the_years_of_the_invoices(spark, sf_dir, tmp_path):
    from balanza.queries.finance import ratio_matrix

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.add_months("o_orderdate", 12 * 9))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    years = [str(y + 9) for y in range(1995, 2002)]
    got, given = ratio_matrix(spark, str(tmp_path)), ratio_matrix(spark, sf_dir)
    assert got.columns == ["taxpayer", "ratio", *years] and given.columns == ["taxpayer", "ratio", *[str(y) for y in range(1995, 2002)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, given.collect()), key=str)


def test_tree_matrix_side_by_side(spark):
    """15 levels beside a short statement, nameless nodes, missing years, document order."""
    node = '{"category": "last", "2020": 5}'
    for i in reversed(range(14)):
        node = '{"category": "%s", "2020": %d, "2019": {"Total": %d}, "children": [%s]}' % ("" if i == 4 else f"n{i}", i, 2 * i, node)
    income = '{"data": [{"category": "b", "2019": 1, "children": [{"category": "z", "2020": 2}, {"category": "a"}]}, {"category": "a", "2018": 9}]}'
    df = spark.createDataFrame([(7, node, income)], "taxpayer int, balance string, income string")
    flats = {c: tree.flatten_tree(df.select("taxpayer", F.parse_json(c).alias("tree")), ["taxpayer"]) for c in ("balance", "income")}
    got = [tuple(r) for r in tree.tree_matrix(flats, (2020, 2019)).orderBy("row_no").collect()]
    names = [f"n{i}" for i in range(14) if i != 4] + ["last"]
    left = [("    " * k + n, float(n[1:]) if n != "last" else 5.0, 2.0 * float(n[1:]) if n != "last" else 0.0) for k, n in enumerate(names)]
    right = [("b", 0.0, 1.0), ("    z", 2.0, 0.0), ("    a", 0.0, 0.0), ("a", 0.0, 0.0)] + [(None, None, None)] * 10
    assert got == [(7, i + 1, *a, *b) for i, (a, b) in enumerate(zip(left, right))]
