"""Trees, ratios, concentration, networks, products, and their report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.operators import network as N, products as P, ratios as R, reports, risk, tree
from balanza.queries.registry import AS_OF, INV, TX, query, with_ctes
from balanza.session import cut
from balanza.sources import adapters as A


def inv(spark, d):
    return A.invoices(spark, d)


# Statement trees: one per taxpayer, with segments below it and priorities below those.
_NODES = """leaf AS (SELECT taxpayer, segment, priority, year(issued) AS year, sum(total) AS v FROM inv GROUP BY ALL),
seg AS (SELECT taxpayer, segment, dense_rank() OVER (PARTITION BY taxpayer ORDER BY segment) - 1 AS i FROM (SELECT DISTINCT taxpayer, segment FROM leaf)),
pri AS (SELECT taxpayer, segment, priority, dense_rank() OVER (PARTITION BY taxpayer, segment ORDER BY priority) - 1 AS j FROM (SELECT DISTINCT taxpayer, segment, priority FROM leaf)),
flat AS (SELECT taxpayer, 0 AS depth, concat('NATION_', taxpayer) AS category, '0' AS place, [0] AS spot, year, 0::DECIMAL(18,2) AS amount FROM (SELECT DISTINCT taxpayer, year FROM leaf)
 UNION ALL SELECT l.taxpayer, 1, l.segment, concat('0/', i), [0, i], year, sum(v) FROM leaf l JOIN seg s ON l.taxpayer = s.taxpayer AND l.segment = s.segment GROUP BY ALL
 UNION ALL SELECT l.taxpayer, 2, l.priority, concat('0/', i, '/', j), [0, i, j], year, v FROM leaf l JOIN seg s ON l.taxpayer = s.taxpayer AND l.segment = s.segment JOIN pri p ON l.taxpayer = p.taxpayer AND l.segment = p.segment AND l.priority = p.priority)"""


def statement_trees(spark, d):
    """(taxpayer, tree): JSON trees of at most 31 nodes, built from grouped invoices."""
    year = F.year("issued").cast("string")

    def years(amount):
        return F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("year"), F.lit('":'), amount))), ",")

    def kids(node):
        return F.array_join(F.array_sort(F.collect_list(node)), ",")

    leaf = inv(spark, d).groupBy("taxpayer", "segment", "priority", year.alias("year")).agg(F.sum("total").alias("v"))
    pri = leaf.groupBy("taxpayer", "segment", "priority").agg(years(F.col("v").cast("string")).alias("y")).select(
        "taxpayer", "segment", F.concat(F.lit('{"category":"'), "priority", F.lit('",'), "y", F.lit("}")).alias("node")
    ).groupBy("taxpayer", "segment").agg(kids(F.col("node")).alias("kids"))
    total = F.concat(F.lit('{"Total":'), F.col("v").cast("string"), F.lit("}"))
    seg = leaf.groupBy("taxpayer", "segment", "year").agg(F.sum("v").alias("v")).groupBy("taxpayer", "segment").agg(years(total).alias("y"))
    seg = seg.join(pri, ["taxpayer", "segment"]).select(
        "taxpayer", F.concat(F.lit('{"category":"'), "segment", F.lit('",'), "y", F.lit(',"children":['), "kids", F.lit("]}")).alias("node")
    ).groupBy("taxpayer").agg(kids(F.col("node")).alias("kids"))
    root = leaf.select("taxpayer", "year").distinct().groupBy("taxpayer").agg(years(F.lit("0")).alias("y"))
    text = F.concat(
        F.lit('{"data":[{"category":"NATION_'), F.col("taxpayer").cast("string"), F.lit('",'), "y", F.lit(',"children":['), "kids", F.lit("]}]}")
    )
    return root.join(seg, "taxpayer").select("taxpayer", F.parse_json(text).alias("tree"))


@query("flatten_tree", with_ctes(INV, _NODES) + "SELECT taxpayer, depth, category, place, year, CAST(amount AS DOUBLE) AS amount FROM flat")
def flatten_tree(spark, d):
    flat = tree.flatten_tree(statement_trees(spark, d), ["taxpayer"])
    return flat.select("taxpayer", "depth", "category", F.array_join("place", "/").alias("place"), "year", "amount")


_ACCOUNTS = {"root": ("balance", ("Nation",)), "urgent": ("balance", ("urgent",)), "machine": ("balance", ("Machinery", "LOW"))}


@query("account_values", with_ctes(INV, _NODES) + """
, hit AS (SELECT taxpayer, year, 'root' AS account, amount, spot FROM flat WHERE lower(category) LIKE '%nation%' AND length(category) < 15
 UNION ALL SELECT taxpayer, year, 'urgent', amount, spot FROM flat WHERE lower(category) LIKE '%urgent%' AND length(category) < 15
 UNION ALL SELECT taxpayer, year, 'machine', amount, spot FROM flat WHERE (lower(category) LIKE '%machinery%' AND length(category) < 22.5) OR (lower(category) LIKE '%low%' AND length(category) < 7.5))
SELECT taxpayer, year, account, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY taxpayer, year, account ORDER BY amount = 0, spot) AS rn FROM hit) WHERE rn = 1""")
def account_values(spark, d):
    flat = tree.flatten_tree(statement_trees(spark, d), ["taxpayer"]).withColumn("statement", F.lit("balance"))
    return tree.account_values(flat, ["taxpayer"], _ACCOUNTS)


# A balance of 15 levels, with a nameless node at every fifth, beside an income statement by status and pay type.
_LEVELS, _YEARS = 15, tuple(range(2001, 1994, -1))


def deep_trees(spark, d):
    """(taxpayer, balance, income) as VARIANT trees of whole amounts."""
    rows = inv(spark, d).withColumns({"year": F.year("issued"), "level": F.col("invoice_id") % _LEVELS, "whole": F.floor("total")})

    def listed(cond):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("year", "whole")))), lambda p: F.concat(F.lit(', "'), p["year"].cast("string"), F.lit('": '), p["whole"].cast("string"))), "")

    deep = rows.groupBy("taxpayer", "year", "level").agg(F.sum("whole").alias("whole")).groupBy("taxpayer").agg(*[listed(F.col("level") == i).alias(f"l{i}") for i in range(_LEVELS)])
    text = F.lit("")
    for i in reversed(range(_LEVELS)):
        name = "" if i % 5 == 3 else f"Nivel {i}"
        text = F.concat(F.lit(f'{{"category": "{name}"'), F.col(f"l{i}"), F.lit(', "children": ['), text, F.lit("]}"))
    flat = rows.groupBy("taxpayer", "year", "status", "pay_type").agg(F.sum("whole").alias("whole"))
    leaf = flat.groupBy("taxpayer", "status", "pay_type").agg(listed(F.lit(True)).alias("v"))
    kids = leaf.groupBy("taxpayer", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pay_type", "v"))), lambda p: F.concat(F.lit('{"category": "'), p["pay_type"], F.lit('"'), p["v"], F.lit("}"))), ", ").alias("k"))
    roots = kids.groupBy("taxpayer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "k"))), lambda p: F.concat(F.lit('{"category": "'), p["status"], F.lit('", "children": ['), p["k"], F.lit("]}"))), ", ").alias("r"))
    income = F.concat(F.lit('{"data": ['), F.col("r"), F.lit("]}"))
    return deep.select("taxpayer", F.parse_json(text).alias("balance")).join(roots.select("taxpayer", F.parse_json(income).alias("income")), "taxpayer")


_SPREAD = ", ".join(f"coalesce(sum(w) FILTER (year = {y}), 0)::DOUBLE AS y{y}" for y in _YEARS)


@query("tree_matrix", with_ctes(INV) + f"""
, r AS (SELECT taxpayer, year(issued) AS year, invoice_id % {_LEVELS} AS level, floor(total) AS w, status, pay_type FROM inv),
t AS (SELECT DISTINCT taxpayer FROM r),
b AS (SELECT t.taxpayer, i AS level, {_SPREAD} FROM t CROSS JOIN (SELECT unnest(range({_LEVELS})) AS i) l LEFT JOIN r ON r.taxpayer = t.taxpayer AND r.level = i WHERE i % 5 <> 3 GROUP BY ALL),
bn AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY level) AS row_no FROM b),
i0 AS (SELECT taxpayer, status, '' AS pay, {", ".join(f"0::DOUBLE AS y{y}" for y in _YEARS)} FROM (SELECT DISTINCT taxpayer, status FROM r) UNION ALL SELECT taxpayer, status, pay_type, {_SPREAD} FROM r GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY status, pay) AS row_no FROM i0)
SELECT coalesce(bn.taxpayer, n.taxpayer) AS taxpayer, coalesce(bn.row_no, n.row_no) AS row_no, CASE WHEN bn.row_no IS NOT NULL THEN concat(repeat('    ', (bn.row_no - 1)::INT), 'Nivel ', level) END AS balance_label, {", ".join(f"bn.y{y} AS balance_y{y}" for y in _YEARS)},
 CASE WHEN pay = '' THEN status WHEN pay IS NOT NULL THEN concat('    ', pay) END AS income_label, {", ".join(f"n.y{y} AS income_y{y}" for y in _YEARS)}
FROM bn FULL JOIN n ON bn.taxpayer = n.taxpayer AND bn.row_no = n.row_no""")
def tree_matrix(spark, d):
    trees = cut(deep_trees(spark, d))
    flats = {name: tree.flatten_tree(trees.select("taxpayer", F.col(name).alias("tree")), ["taxpayer"]) for name in ("balance", "income")}
    return tree.tree_matrix(flats, _YEARS)


# Yearly inputs: each account is the sum of the invoices with its remainder.
_NAMES = list(R.ACCOUNTS)
_VALUES = ("vals AS (SELECT taxpayer, year(issued) AS year, invoice_id % 29 AS k, CAST(sum(total) AS DOUBLE) AS v FROM inv GROUP BY ALL),\n"
           "inputs AS (SELECT taxpayer, year, " + ", ".join(f"coalesce(max(v) FILTER (k = {i}), 0) AS {n}" for i, n in enumerate(_NAMES))
           + " FROM vals GROUP BY ALL), flow AS (SELECT taxpayer, year(issued) AS year, CAST(sum(CASE WHEN status = 'paid' THEN total ELSE -total END) AS DOUBLE) AS operating_cash_flow FROM inv GROUP BY ALL),\n"
           "yin AS (SELECT i.*, round((ebt_profit - ebt_loss) - (net_profit - net_loss), 2) AS taxes, f.operating_cash_flow FROM inputs i JOIN flow f ON i.taxpayer = f.taxpayer AND i.year = f.year)")


def year_inputs_frame(spark, d):
    rows = inv(spark, d)
    k = F.col("invoice_id") % 29
    account = F.get(F.array(*[F.lit(n) for n in _NAMES]), k.cast("int"))
    values = rows.groupBy("taxpayer", F.year("issued").alias("year"), account.alias("account")).agg(F.sum("total").alias("amount"))
    flow = rows.groupBy("taxpayer", F.year("issued").alias("year")).agg(
        F.sum(F.when(F.col("status") == "paid", F.col("total")).otherwise(-F.col("total"))).alias("operating_cash_flow")
    )
    return R.year_inputs(values, flow)


@query("year_inputs", with_ctes(INV, _VALUES) + "SELECT * FROM yin")
def year_inputs(spark, d):
    return year_inputs_frame(spark, d)


def _safe(num, den):
    return f"coalesce(({num}) / nullif({den}, 0), 0)"


_RATIOS = {
    "roa": (_safe("net_income", "assets"), 4), "roe": (_safe("net_income", "equity"), 4), "net_margin_pct": (_safe("net_income", "revenue") + " * 100", 2),
    "roa_before_tax": (_safe("ebt", "assets"), 4), "current_ratio": (_safe("current_assets", "current_liabilities"), 2),
    "quick_ratio": (_safe("current_assets - inventory", "current_liabilities"), 2), "cash_ratio": (_safe("cash_and_equivalents", "current_liabilities"), 2),
    "leverage": (_safe("liabilities", "equity"), 2), "debt_ratio": (_safe("liabilities", "assets"), 4), "interest_coverage": (_safe("ebit", "abs(interest_expense)"), 2),
    "cash_flow_coverage": (_safe("operating_cash_flow", "liabilities"), 2), "working_capital": ("wc", 2), "dio": (_safe("inventory", "abs(cogs)") + " * 365", 1),
    "dso": (_safe("accounts_receivable", "revenue") + " * 365", 1), "dpo": (_safe("accounts_payable", "abs(cogs)") + " * 365", 1),
    "fixed_asset_turnover": (_safe("revenue", "fixed_assets"), 2), "total_asset_turnover": (_safe("revenue", "assets"), 2),
    "altman_z": (f"1.2::DOUBLE * {_safe('wc', 'assets')} + 1.4::DOUBLE * {_safe('retained_earnings', 'assets')} + 3.3::DOUBLE * {_safe('ebit', 'assets')} + 0.6::DOUBLE * {_safe('equity', 'liabilities')} + {_safe('revenue', 'assets')}", 2),
    "operating_cash_flow": ("operating_cash_flow", 2), "ebit": ("ebit", 2), "ebt": ("ebt", 2), "nopat": ("ebit - taxes", 2), "gross_income": ("gross_income", 2),
    "net_income": ("net_income", 2), "taxes": ("taxes", 2),
}
_SIGNED = """sg AS (SELECT *, CASE WHEN gross_profit <> 0 THEN gross_profit WHEN gross_loss > 0 THEN -gross_loss ELSE 0 END AS gross_income, CASE WHEN net_profit <> 0 THEN net_profit WHEN net_loss > 0 THEN -net_loss ELSE 0 END AS net_income,
 CASE WHEN ebit_profit <> 0 THEN ebit_profit WHEN ebit_loss > 0 THEN -ebit_loss ELSE 0 END AS ebit, CASE WHEN ebt_profit <> 0 THEN ebt_profit WHEN ebt_loss > 0 THEN -ebt_loss ELSE 0 END AS ebt0, current_assets - current_liabilities AS wc FROM yin),
sh AS (SELECT *, CASE WHEN ebt0 = 0 AND net_income <> 0 THEN net_income + taxes ELSE ebt0 END AS ebt FROM sg),
rat AS (SELECT taxpayer, year, """ + ", ".join(f"round({e}, {p}) AS {n}" for n, (e, p) in _RATIOS.items()) + " FROM sh)"


@query("financial_ratios", with_ctes(INV, _VALUES, _SIGNED) + "SELECT * FROM rat")
def financial_ratios(spark, d):
    return R.ratios(year_inputs_frame(spark, d))


# All years that the given invoices have, for the SQL; the query reads them.
_ALL_YEARS = tuple(range(1995, 2002))


@query("ratio_matrix", with_ctes(INV, _VALUES, _SIGNED) + ", u AS (SELECT taxpayer, year, unnest([" + ", ".join(f"'{n}'" for n in _RATIOS) + "]) AS ratio, unnest([" + ", ".join(f"{n}::DOUBLE" for n in _RATIOS) + """]) AS v FROM rat)
SELECT taxpayer, ratio, """ + ", ".join(f'max(v) FILTER (year = {y}) AS "{y}"' for y in _ALL_YEARS) + """ FROM u GROUP BY ALL""")
def ratio_matrix(spark, d):
    years = sorted(r[0] for r in inv(spark, d).select(F.year("issued")).distinct().dropna().collect())  # a row a year
    return reports.unpivot_pivot(financial_ratios(spark, d), ["taxpayer"], "year", years, list(_RATIOS), "ratio")


# Concentration.
_CONC = """mon AS (SELECT taxpayer, counterparty, date_trunc('month', issued)::DATE AS month, sum(total) AS total, count(*) AS n, min(name) AS name FROM inv WHERE issued BETWEEN DATE '2001-08-15' - 365 AND DATE '2001-08-15' GROUP BY ALL),
placed AS (SELECT *, month <> DATE '2001-08-01' AS closed, count(*) FILTER (month <> DATE '2001-08-01') OVER (PARTITION BY taxpayer, counterparty ORDER BY month) - 1 AS x FROM mon),
node AS (SELECT taxpayer, counterparty, min(name) AS name, sum(total) AS total, sum(n)::BIGINT AS invoices, string_agg(concat(month, ':', total), ',' ORDER BY month) AS history, count(*) FILTER (closed) AS k,
 sum(x) FILTER (closed) AS sx, sum(x * x) FILTER (closed) AS sxx, sum(CAST(total * 100 AS HUGEINT)) FILTER (closed) AS sy, sum(CAST(total * 100 AS HUGEINT) * x) FILTER (closed) AS sxy FROM placed GROUP BY ALL),
conc AS (SELECT *, coalesce(CASE WHEN k * sxx - sx * sx <> 0 THEN (k * sxy - sx * sy)::DOUBLE / ((k * sxx - sx * sx) * 100)::DOUBLE END, 0) AS slope, total::DOUBLE / (sum(total) OVER (PARTITION BY taxpayer))::DOUBLE AS share FROM node)"""


def _concentration(spark, d):
    return N.concentration(inv(spark, d), AS_OF, slope_digits=6)


@query("concentration", with_ctes(INV, _CONC) + """
SELECT taxpayer, counterparty, name, CAST(total AS DOUBLE) AS total, round(share, 6) AS share, invoices, history, round(slope, 6) AS slope,
 CASE WHEN k < 2 THEN 'Sin datos' WHEN slope > 100 THEN 'Creciendo' WHEN slope < -100 THEN 'Disminuyendo' ELSE 'Constante' END AS trend FROM conc""")
def concentration(spark, d):
    history = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["month"].cast("string"), h["total"].cast("string"))), ",")
    return _concentration(spark, d).select("taxpayer", "counterparty", "name", "total", F.round("share", 6).alias("share"), "invoices", history.alias("history"), "slope", "trend")


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY total DESC, counterparty) AS rank FROM conc)"


@query("top_counterparties", with_ctes(INV, _CONC, _TOP) + "SELECT taxpayer, counterparty, CAST(total AS DOUBLE) AS total, round(share, 6) AS share, rank FROM top WHERE rank <= 5")
def top_counterparties(spark, d):
    return N.top_counterparties(_concentration(spark, d)).select("taxpayer", "counterparty", "total", F.round("share", 6).alias("share"), "rank")


# All months of the look-back of a year.
_MONTHS = [f"{2000 + (7 + i) // 12}-{(7 + i) % 12 + 1:02d}" for i in range(13)]


@query("concentration_matrix", with_ctes(INV, _CONC, _TOP) + """
SELECT t.taxpayer, t.counterparty, CAST(max(t.total) AS DOUBLE) AS total, """ + ", ".join(f"""CAST(sum(CASE WHEN strftime(m.month, '%Y-%m') = '{m}' THEN m.total ELSE 0 END) AS DOUBLE) AS "{m}" """ for m in _MONTHS) + """
FROM top t JOIN mon m ON t.taxpayer = m.taxpayer AND t.counterparty = m.counterparty WHERE rank <= 5 GROUP BY t.taxpayer, t.counterparty""")
def concentration_matrix(spark, d):
    top = N.top_counterparties(_concentration(spark, d))
    months = top.select("taxpayer", "counterparty", F.explode("history").alias("h")).select("taxpayer", "counterparty", "h.month", "h.total")
    return reports.concentration_matrix(months, top, _MONTHS)


@query("trade_network", with_ctes(INV) + """
, i AS (SELECT *, CASE WHEN invoice_id % 9 = 0 THEN 10.50 ELSE 0 END AS discount FROM inv),
n AS (SELECT taxpayer, counterparty, min(name) AS name, sum(total)::DOUBLE AS received, sum(CASE WHEN status = 'cancelled' THEN total ELSE 0 END)::DOUBLE AS cancelled, sum(discount)::DOUBLE AS discounts, 0::DOUBLE AS credit_notes,
 sum(CASE WHEN status = 'open' THEN total ELSE 0 END)::DOUBLE AS pending, sum(CASE WHEN status <> 'cancelled' AND pay_type = 'PUE' THEN total ELSE 0 END)::DOUBLE AS pue, sum(CASE WHEN status <> 'cancelled' AND pay_type = 'PPD' THEN total ELSE 0 END)::DOUBLE AS ppd,
 count(*) FILTER (status <> 'cancelled' AND pay_type = 'PPD') AS ppd_count, sum(CASE WHEN status = 'paid' THEN total ELSE 0 END)::DOUBLE AS paid, sum(CASE WHEN status = 'paid' AND pay_type = 'PPD' THEN total ELSE 0 END)::DOUBLE AS in_installments,
 (sum(total) - sum(CASE WHEN status = 'cancelled' THEN total ELSE 0 END) - sum(discount))::DOUBLE AS net FROM i GROUP BY ALL)
SELECT *, round(coalesce(cancelled / nullif(received, 0), 0), 4) AS cancelled_pct, round(coalesce(pending / nullif(net, 0), 0) * 365, 1) AS days_outstanding FROM n""")
def trade_network(spark, d):
    rows = inv(spark, d).withColumn("discount", F.when(F.col("invoice_id") % 9 == 0, F.lit(10.5)).otherwise(F.lit(0)).cast("decimal(18,2)"))
    return N.trade_network(rows)


_INST = """m AS (SELECT taxpayer, counterparty, date_trunc('month', issued)::DATE AS month, sum(CASE WHEN status = 'cancelled' THEN 0 ELSE total END) AS total, min(name) AS name FROM inv WHERE issued >= DATE '2001-08-15' - 1095 GROUP BY ALL),
inst AS (SELECT taxpayer, counterparty, min(name) AS name, sum(total) AS total, min(month) FILTER (total > 0) AS first_month, max(month) FILTER (total > 0) AS last_month, count(*) FILTER (total > 0) AS active_months FROM m GROUP BY ALL)"""


def _institutions(spark, d):
    rows = inv(spark, d).filter(F.col("issued") >= F.date_sub(F.lit(AS_OF).cast("date"), 1095))
    live = rows.withColumn("total", F.when(F.col("status") == "cancelled", F.lit(0).cast("decimal(18,2)")).otherwise(F.col("total")))
    return N.institutions(N.node_months(live))


@query("institution_activity", with_ctes(INV, _INST) + "SELECT taxpayer, counterparty, name, CAST(total AS DOUBLE) AS total, first_month::VARCHAR AS first_month, last_month::VARCHAR AS last_month, active_months FROM inst")
def institution_activity(spark, d):
    return _institutions(spark, d)


@query("top_institutions", with_ctes(INV, _INST) + "SELECT taxpayer, counterparty, CAST(total AS DOUBLE) AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY total DESC, counterparty) AS rank FROM inst) WHERE rank <= 10")
def top_institutions(spark, d):
    return N.top_counterparties(_institutions(spark, d), 10).select("taxpayer", "counterparty", "total", "rank")


# Blacklist: every third counterparty is listed, once per side it has invoices on.
_BLACK = """sided AS (SELECT *, CASE WHEN pay_type = 'PUE' THEN 'issued' ELSE 'received' END AS side FROM inv),
listed0 AS (SELECT taxpayer, counterparty, side, min(name) AS nm, count(*) AS invoices FROM sided WHERE counterparty % 3 = 0 GROUP BY ALL),
listed AS (SELECT taxpayer, counterparty, side, CASE WHEN counterparty % 2 = 0 THEN '' ELSE nm END AS name, CASE counterparty % 4 WHEN 0 THEN 'definitive' WHEN 1 THEN 'presumed' WHEN 2 THEN 'favorable' ELSE 'dismissed' END AS status,
 invoices FROM listed0),
rich AS (SELECT l.*, s.amount, s.last_date FROM listed l JOIN (SELECT taxpayer, counterparty, side, sum(total) AS amount, max(issued) AS last_date FROM sided GROUP BY ALL) s ON l.taxpayer = s.taxpayer AND l.counterparty = s.counterparty AND l.side = s.side)"""


def _blacklist(spark, d):
    sided = inv(spark, d).withColumn("side", F.when(F.col("pay_type") == "PUE", "issued").otherwise("received"))
    k = F.col("counterparty")
    status = F.when(k % 4 == 0, "definitive").when(k % 4 == 1, "presumed").when(k % 4 == 2, "favorable").otherwise("dismissed")
    listed = sided.filter(k % 3 == 0).groupBy("taxpayer", "counterparty", "side").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("invoices"))
    listed = listed.withColumns({"name": F.when(k % 2 == 0, "").otherwise(F.col("name")), "status": status})
    return N.blacklist_enrich(listed, sided.drop("name"))


@query("blacklist_enrich", with_ctes(INV, _BLACK) + "SELECT taxpayer, counterparty, side, name, status, invoices, CAST(amount AS DOUBLE) AS amount, last_date::VARCHAR AS last_date FROM rich")
def blacklist_enrich(spark, d):
    return _blacklist(spark, d).select("taxpayer", "counterparty", "side", "name", "status", "invoices", "amount", "last_date")


@query("blacklist_exposure", with_ctes(INV, _BLACK) + """
SELECT taxpayer, counterparty, arg_min(CASE WHEN name = '' THEN 'N/A' ELSE name END, side) AS name, min(status) AS status, coalesce(sum(invoices) FILTER (side = 'issued'), 0)::BIGINT AS issued_count, coalesce(sum(amount) FILTER (side = 'issued'), 0)::DOUBLE AS issued_amount,
 coalesce(sum(invoices) FILTER (side = 'received'), 0)::BIGINT AS received_count, coalesce(sum(amount) FILTER (side = 'received'), 0)::DOUBLE AS received_amount, max(last_date)::VARCHAR AS last_date, sum(amount)::DOUBLE AS total_amount, min(status) IN ('definitive', 'presumed') AS red_flag FROM rich GROUP BY ALL""")
def blacklist_exposure(spark, d):
    return N.blacklist_exposure(_blacklist(spark, d), order="side")


@query("network_report", with_ctes(INV, _CONC, _TOP) + """
SELECT taxpayer, counterparty, CAST(2001 - CASE WHEN counterparty % 100 > 1 THEN 1900 + counterparty % 100 ELSE 2000 + counterparty % 100 END AS BIGINT) AS age, round(CASE WHEN share * 20 > 1 THEN share * 20 / 100 ELSE share * 20 END, 6) AS share_fixed FROM top WHERE rank <= 5""")
def network_report(spark, d):
    top = N.top_counterparties(_concentration(spark, d))
    rows = top.withColumns({
        "rfc": F.concat(F.lit("ABC"), F.lpad((F.col("counterparty") % 100).cast("string"), 2, "0"), F.lit("0101XY1")), "share": F.col("share") * 20,
    })
    return reports.network_report(rows, AS_OF).select("taxpayer", "counterparty", "age", F.round("share_fixed", 6).alias("share_fixed"))


# Products.
_PROD = """sold AS (SELECT s_nationkey AS taxpayer, posted, amount, CASE WHEN part_key % 7 = 0 THEN CASE WHEN part_key % 2 = 0 THEN 'Sin descripción' ELSE 'detalle' END ELSE regexp_extract(description, '^\\S+ \\S+') END AS name,
 CASE WHEN part_key % 5 = 0 THEN CASE WHEN part_key % 3 = 0 THEN 'N/A' ELSE concat('C', part_key % 3) END ELSE concat('P', part_key % 10) END AS code FROM tx JOIN supplier ON doc_id = s_suppkey),
mix AS (SELECT taxpayer, code, name, sum(amount) AS total, count(*) AS transactions FROM sold GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY total DESC, code, name) AS rank FROM mix)"""


def _sold(spark, d):
    k = F.col("part_key")
    rows = A.movements(spark, d).join(A.table(spark, d, "supplier"), F.col("doc_id") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_nationkey").alias("taxpayer"), "posted", "amount",
        F.when(k % 7 == 0, "").otherwise(F.substring_index("description", " ", 2)).alias("name"), F.when(k % 2 != 0, "detalle").alias("detail"),
        F.when(k % 5 != 0, F.concat(F.lit("P"), (k % 10).cast("string"))).alias("product_code"), F.when(k % 3 != 0, F.concat(F.lit("C"), (k % 3).cast("string"))).alias("code"),
    )


@query("product_mix", with_ctes(TX, _PROD) + "SELECT taxpayer, code, name, CAST(total AS DOUBLE) AS total, transactions, round(total::DOUBLE / (sum(total) OVER (PARTITION BY taxpayer))::DOUBLE, 6) AS share FROM mix")
def product_mix(spark, d):
    return P.product_mix(_sold(spark, d)).withColumn("share", F.round("share", 6))


@query("top_products", with_ctes(TX, _PROD) + "SELECT taxpayer, code, name, CAST(total AS DOUBLE) AS total, rank FROM ranked WHERE rank <= 10")
def top_products(spark, d):
    return P.top_products(P.product_mix(_sold(spark, d)), 10).select("taxpayer", "code", "name", "total", "rank")


@query("product_timeline", with_ctes(TX, _PROD) + """
SELECT r.taxpayer, r.code, r.name, date_trunc('month', s.posted)::DATE::VARCHAR AS month, CAST(sum(s.amount) AS DOUBLE) AS month_total, CAST(max(r.total) AS DOUBLE) AS total, max(r.rank) AS rank
FROM ranked r JOIN sold s ON r.taxpayer = s.taxpayer AND r.code = s.code AND r.name = s.name WHERE rank <= 10 GROUP BY ALL""")
def product_timeline(spark, d):
    rows = _sold(spark, d)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("detail"), F.lit("Sin descripción"))
    code = F.coalesce("product_code", "code", F.lit("N/A"))
    return P.product_timeline(rows.select("taxpayer", code.alias("code"), name.alias("name"), "posted", "amount"))


@query("resolve_name", with_ctes(INV) + """
, n AS (SELECT taxpayer, CASE status WHEN 'paid' THEN 1 WHEN 'open' THEN 2 ELSE 3 END AS p, CASE WHEN taxpayer % 4 <> 0 AND NOT (taxpayer % 2 = 0 AND status = 'paid') THEN name ELSE '' END AS name FROM inv UNION ALL SELECT n_nationkey, 9, '' FROM nation)
SELECT n_nationkey AS taxpayer, coalesce((SELECT arg_min(name, concat(p, name)) FROM n WHERE n.taxpayer = n_nationkey AND name <> ''), n_nationkey::VARCHAR) AS name FROM nation""")
def resolve_name(spark, d):
    spine = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("taxpayer"))
    # some feeds have no name
    named = (F.col("taxpayer") % 4 != 0) & ~((F.col("taxpayer") % 2 == 0) & (F.col("status") == "paid"))
    rows = inv(spark, d).withColumn("name", F.when(named, F.col("name")).otherwise(""))
    names = rows.select("taxpayer", F.when(F.col("status") == "paid", 1).when(F.col("status") == "open", 2).otherwise(3).alias("priority"), "name")
    return risk.resolve_name(spine, names.unionByName(spine.select("taxpayer", F.lit(9).alias("priority"), F.lit("").alias("name"))))


@query("latest_per_key", with_ctes(INV) + """
SELECT counterparty, invoice_id, issued::VARCHAR AS issued, CASE WHEN status = 'cancelled' THEN 'not_found' WHEN status = 'paid' THEN 'active' ELSE 'inactive' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY counterparty ORDER BY issued DESC, invoice_id DESC) AS rn FROM inv) WHERE rn = 1""")
def latest_per_key(spark, d):
    rows = inv(spark, d).select("counterparty", "invoice_id", "issued", "status")
    raw = F.when(F.col("status") == "paid", "valid").when(F.col("status") == "open", "invalid")
    return risk.latest(rows, ["counterparty"], "issued", "invoice_id").select("counterparty", "invoice_id", "issued", risk.credential_status(raw).alias("status"))


@query("assemble_taxpayer", with_ctes(INV) + """
SELECT n_nationkey AS taxpayer, coalesce(i.billed, 0)::DOUBLE AS billed, coalesce(s.suppliers, 0) AS suppliers, coalesce(c.status, 'entity_not_found') AS status FROM nation
LEFT JOIN (SELECT taxpayer, sum(total) AS billed FROM inv GROUP BY ALL) i ON i.taxpayer = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT DISTINCT taxpayer, 'found' AS status FROM inv WHERE taxpayer % 3 = 0) c ON c.taxpayer = n_nationkey""")
def assemble_taxpayer(spark, d):
    rows = inv(spark, d)
    spine = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("taxpayer"))
    billed = rows.groupBy("taxpayer").agg(F.sum("total").alias("billed"))
    suppliers = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("taxpayer")).agg(F.count(F.lit(1)).alias("suppliers"))
    bureau = rows.filter("taxpayer % 3 = 0").select("taxpayer", F.lit("found").alias("status")).distinct()
    return risk.assemble(spine, {
        "invoices": (billed, {"billed": 0}), "suppliers": (suppliers, {"suppliers": 0}), "bureau": (bureau, {"status": "entity_not_found"}),
    })
