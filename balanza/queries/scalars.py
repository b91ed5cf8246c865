"""Scalar columns over movements and invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.functions import dates as D, ids, money, parse, text as X
from balanza.operators import bank_lines, reconcile, screening
from balanza.queries.registry import AS_OF, INV, TX, query, with_ctes
from balanza.rules import catalog
from balanza.sources import adapters as A


def mov(spark, d):
    return A.movements(spark, d)


def inv(spark, d):
    return A.invoices(spark, d)


_RAW = """raw AS (SELECT mov_id, line_no, amount, CASE line_no WHEN 1 THEN concat(' $', amount::VARCHAR, ' ') WHEN 2 THEN concat(quantity, ',', lpad((order_key % 1000)::VARCHAR, 3, '0'), '.50')
 WHEN 3 THEN 'n/a' WHEN 4 THEN NULL WHEN 5 THEN concat('-', amount::VARCHAR) WHEN 6 THEN '' ELSE concat(quantity, '') END AS money FROM tx)"""


def _money_text():
    line = F.col("line_no")
    return (
        F.when(line == 1, F.concat(F.lit(" $"), F.col("amount").cast("string"), F.lit(" ")))
        .when(line == 2, F.concat(F.col("quantity").cast("string"), F.lit(","), F.lpad((F.col("order_key") % 1000).cast("string"), 3, "0"), F.lit(".50")))
        .when(line == 3, "n/a").when(line == 4, None).when(line == 5, F.concat(F.lit("-"), F.col("amount").cast("string")))
        .when(line == 6, "").otherwise(F.col("quantity").cast("string"))
    )


@query("clean_amount", with_ctes(TX, _RAW) + "SELECT mov_id, coalesce(try_cast(trim(replace(replace(money, '$', ''), ',', '')) AS DOUBLE), 0) AS amount FROM raw")
def clean_amount(spark, d):
    return mov(spark, d).select("mov_id", money.clean_amount(_money_text()).alias("amount"))


@query("sum_amount_list", with_ctes(TX, _RAW) + """
SELECT mov_id, round(list_sum(list_transform([money, '10.25', ' 1,000 ', 'x'], lambda x: coalesce(try_cast(trim(replace(x, ',', '')) AS DOUBLE), 0))), 4) AS total FROM raw""")
def sum_amount_list(spark, d):
    items = F.array(_money_text(), F.lit("10.25"), F.lit(" 1,000 "), F.lit("x"))
    return mov(spark, d).select("mov_id", F.round(money.sum_amounts(items), 4).alias("total"))


@query("bureau_amount", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 3 WHEN 2 THEN 0 ELSE CAST(total AS DOUBLE) END AS amount FROM inv""")
def bureau_amount(spark, d):
    total, k = F.col("total").cast("string"), F.col("invoice_id") % 3
    raw = F.when(k == 0, F.concat(F.lpad(total, 14, "0"), F.lit("+"))).when(k == 1, F.concat(F.lit("-"), total)).otherwise("no")
    return inv(spark, d).select("invoice_id", money.bureau_amount(raw).alias("amount"))


@query("clean_company", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 6 WHEN 5 THEN '' WHEN 4 THEN concat('customer', counterparty, ' sa de cv') WHEN 3 THEN concat('nino ', counterparty) ELSE concat('customer ', counterparty) END AS name FROM inv""")
def clean_company(spark, d):
    k, who = F.col("invoice_id") % 6, F.col("counterparty").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("Customer "), who, F.lit(", SA de CV")))
        .when(k == 1, F.concat(F.lit("CUSTOMER  "), who, F.lit(" S de RL")))
        .when(k == 2, F.concat(F.lit("Cústomer "), who, F.lit(" SAPI de CV")))
        .when(k == 3, F.concat(F.lit("Niño "), who, F.lit(" (CV)")))
        .when(k == 4, F.concat(F.lit("Customer#"), who, F.lit(" S.A. DE C.V.")))
        .otherwise(F.lit("Desconocido"))
    )
    return inv(spark, d).select("invoice_id", X.clean_company(raw).alias("name"))


_MON = "CASE month(posted) WHEN 1 THEN 'ENE' WHEN 2 THEN 'FEB' WHEN 3 THEN 'MAR' WHEN 4 THEN 'ABR' WHEN 5 THEN 'MAY' WHEN 6 THEN 'JUN' WHEN 7 THEN 'JUL' WHEN 8 THEN 'AGO' WHEN 9 THEN 'SEP' WHEN 10 THEN 'OCT' WHEN 11 THEN 'NOV' ELSE 'DIC' END"


def _month_name():
    return F.upper(F.element_at(F.array(*[F.lit(m) for m in D.SPANISH_MONTHS]), F.month("posted")))


@query("split_date_noise", with_ctes(TX) + f"""
SELECT mov_id, CASE line_no WHEN 1 THEN concat(strftime(posted, '%d'), '-', {_MON}, '-', strftime(posted, '%y')) WHEN 2 THEN concat(strftime(posted, '%d'), ' / ', strftime(posted, '%m/%Y'))
 WHEN 3 THEN concat(strftime(posted, '%d'), '/', {_MON}) ELSE description END AS day_text, CASE WHEN line_no <= 3 THEN description ELSE '' END AS noise FROM tx""")
def split_date_noise(spark, d):
    line = F.col("line_no")
    raw = (
        F.when(line == 1, F.concat(F.date_format("posted", "dd-"), _month_name(), F.date_format("posted", "-yy "), "description"))
        .when(line == 2, F.concat(F.date_format("posted", "dd / MM/yyyy"), F.lit(" "), "description"))
        .when(line == 3, F.concat(F.date_format("posted", "dd/"), _month_name(), F.lit(" "), "description"))
        .otherwise(F.col("description"))
    )
    return mov(spark, d).select("mov_id", D.split_date_noise(raw).alias("p")).select("mov_id", "p.day_text", "p.noise")


_PERIOD = f"""per AS (SELECT *, CASE WHEN order_key % 5 = 0 THEN NULL ELSE CAST(date_trunc('month', posted) AS DATE) + 19 END AS s,
 CASE WHEN order_key % 7 = 0 THEN NULL ELSE CAST(CAST(date_trunc('month', posted) AS DATE) + 19 + to_months(1) AS DATE) END AS e,
 CASE line_no WHEN 1 THEN concat(day(posted), '/', {_MON}, ' x') WHEN 2 THEN strftime(posted, '%d/%m/%y') WHEN 3 THEN concat('| ', day(posted)) WHEN 4 THEN (100 + day(posted))::VARCHAR
 WHEN 5 THEN '999' WHEN 6 THEN 'abc' ELSE strftime(posted, '%d-%m-%Y') END AS rawd FROM tx),
cand AS (SELECT *, day(posted) AS dd, list_filter([try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', year(s), month(s), day(posted)) AS DATE), CASE WHEN month(e) <> month(s) OR year(e) <> year(s) THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', year(e), month(e), day(posted)) AS DATE) END,
 try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', year(s + to_months(1)), month(s + to_months(1)), day(posted)) AS DATE)], lambda x: x IS NOT NULL) AS c FROM per),
chose AS (SELECT *, coalesce(list_filter(c, lambda x: x BETWEEN s AND e)[1], CASE WHEN e IS NOT NULL AND month(s) <> month(e) AND dd < day(s) THEN CASE WHEN len(c) > 1 THEN c[2] ELSE c[1] END ELSE c[1] END) AS pick FROM cand),
full_date AS (SELECT *, CASE WHEN line_no = 1 THEN CASE WHEN s IS NULL THEN rawd ELSE format('{{:02d}}/{{:02d}}/{{}}', dd, month(posted),
 CASE WHEN year(e) <> year(s) AND month(posted) = month(e) THEN year(e) WHEN month(s) >= 11 AND month(posted) = 1 THEN year(s) + 1 ELSE year(s) END) END
 WHEN line_no = 2 THEN concat(strftime(posted, '%d/%m/'), '20', strftime(posted, '%y')) WHEN line_no = 7 THEN strftime(posted, '%d/%m/%Y') WHEN line_no = 5 THEN '999/??/???? (Inválido)' WHEN line_no = 6 THEN 'abc'
 WHEN s IS NULL THEN format('{{:02d}}/??/????', dd) WHEN pick IS NOT NULL THEN strftime(pick, '%d/%m/%Y') ELSE format('{{:02d}}/{{:02d}}/{{}}', dd, month(s), year(s)) END AS shown FROM chose)"""


def _period_frame(spark, d):
    line = F.col("line_no")
    start = F.date_add(F.trunc("posted", "month"), 19)
    raw = (
        F.when(line == 1, F.concat(F.dayofmonth("posted").cast("string"), F.lit("/"), _month_name(), F.lit(" x")))
        .when(line == 2, F.date_format("posted", "dd/MM/yy")).when(line == 3, F.concat(F.lit("| "), F.dayofmonth("posted").cast("string")))
        .when(line == 4, (F.dayofmonth("posted") + 100).cast("string")).when(line == 5, "999").when(line == 6, "abc")
        .otherwise(F.date_format("posted", "dd-MM-yyyy"))
    )
    return mov(spark, d).select(
        "mov_id", raw.alias("raw"), F.when(F.col("order_key") % 5 != 0, start).alias("s"),
        F.when(F.col("order_key") % 7 != 0, F.add_months(start, 1)).alias("e"),
    )


@query("complete_date", with_ctes(TX, _PERIOD) + "SELECT mov_id, shown FROM full_date")
def complete_date(spark, d):
    return D.complete_date(_period_frame(spark, d), "raw", "s", "e").select("mov_id", "shown")


@query("movement_period", with_ctes(TX, _PERIOD) + """
SELECT mov_id, CASE WHEN NOT contains(shown, '??') AND len(string_split(shown, '/')) = 3 THEN concat('01-', lpad(string_split(shown, '/')[2], 2, '0'), '-', string_split(shown, '/')[3])
 WHEN s IS NOT NULL THEN strftime(s, '01-%m-%Y') ELSE '01-01-1900' END AS period FROM full_date""")
def movement_period(spark, d):
    shown = D.complete_date(_period_frame(spark, d), "raw", "s", "e")
    return shown.select("mov_id", D.movement_period(F.col("shown"), F.col("s")).alias("period"))


@query("api_month", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 4 WHEN 3 THEN strftime(issued, '%Y-%m-%d') ELSE strftime(issued, '%Y-%m') END AS month FROM inv""")
def api_month(spark, d):
    k = F.col("invoice_id") % 4
    spanish = F.initcap(F.element_at(F.array(*[F.lit(m) for m in D.SPANISH_MONTHS]), F.month("issued")))
    raw = (
        F.when(k == 0, F.date_format("issued", "yyyy/MMM")).when(k == 1, F.date_format("issued", "yyyy-M"))
        .when(k == 2, F.concat(F.date_format("issued", "yyyy/"), spanish)).otherwise(F.date_format("issued", "yyyy/MM/dd"))
    )
    return inv(spark, d).select("invoice_id", D.api_month(raw).alias("month"))


@query("bureau_date", with_ctes(INV) + """
SELECT invoice_id, strftime(issued, '%Y-%m-%d') AS opened, CASE invoice_id % 2 WHEN 0 THEN strftime(issued, '%Y-%m-01') ELSE strftime(issued, '%Y-%m-%d') END AS updated,
 CASE invoice_id % 3 WHEN 2 THEN DATE '2001-08-15'::VARCHAR ELSE strftime(issued, '%Y-%m-%d') END AS consulted FROM inv""")
def bureau_date(spark, d):
    k = F.col("invoice_id")
    short = F.date_format("issued", "ddMMyyyy")
    return inv(spark, d).select(
        "invoice_id", D.bureau_date(short).alias("opened"),
        D.bureau_update_date(F.when(k % 2 == 0, F.date_format("issued", "yyyyMM")).otherwise(short)).alias("updated"),
        D.consult_date(F.when(k % 3 == 0, F.date_format("issued", "yyyy-MM-dd'T00:00:00Z'")).when(k % 3 == 1, short).otherwise("x"), AS_OF).alias("consulted"),
    )


@query("recent_proof", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 5 <> 0 THEN issued >= DATE '2001-05-15' END AS recent FROM inv""")
def recent_proof(spark, d):
    raw = F.when(F.col("invoice_id") % 5 == 0, "ayer").otherwise(F.col("issued").cast("string"))
    return inv(spark, d).select("invoice_id", D.recent_proof(raw, AS_OF).alias("recent"))


@query("rfc_age", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 5 <> 4 THEN CAST(2001 - CASE WHEN counterparty % 100 > 1 THEN 1900 + counterparty % 100 ELSE 2000 + counterparty % 100 END AS DOUBLE) END AS age FROM inv""")
def rfc_age(spark, d):
    yy = F.lpad((F.col("counterparty") % 100).cast("string"), 2, "0")
    k = F.col("invoice_id") % 5
    raw = F.when(k == 4, "ABC").when(k % 2 == 0, F.concat(F.lit("ABC"), yy, F.lit("0101XY1"))).otherwise(F.concat(F.lit(" ABCD"), yy, F.lit("0101XY1 ")))
    return inv(spark, d).select("invoice_id", D.rfc_age(raw, AS_OF).cast("double").alias("age"))


@query("seniority_years", with_ctes(INV) + """
SELECT invoice_id, date_diff('year', issued, DATE '2001-08-15') - CASE WHEN strftime(issued, '%m%d') > '0815' THEN 1 ELSE 0 END AS exact_years, CAST(floor((DATE '2001-08-15' - issued) / 365) AS BIGINT) AS day_years FROM inv""")
def seniority_years(spark, d):
    return inv(spark, d).select(
        "invoice_id", D.seniority_years(F.col("issued"), AS_OF).alias("exact_years"), D.seniority_days(F.col("issued"), AS_OF).alias("day_years")
    )


@query("fix_percent", with_ctes(INV) + "SELECT invoice_id, CASE WHEN total / 100000 > 1 THEN CAST(total AS DOUBLE) / 100000.0::DOUBLE / 100.0::DOUBLE ELSE CAST(total AS DOUBLE) / 100000.0::DOUBLE END AS share FROM inv")
def fix_percent(spark, d):
    return inv(spark, d).select("invoice_id", money.fix_percent(F.col("total").cast("double") / F.lit(100000.0)).alias("share"))


@query("certificate_defaults", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN 'Tienda' WHEN invoice_id % 3 = 0 THEN NULL ELSE concat('Ana ', name) END AS nombre_comercial,
 CASE WHEN invoice_id % 4 IN (1, 3) THEN NULL ELSE segment END AS colonia FROM inv""")
def certificate_defaults(spark, d):
    k = F.col("invoice_id")
    none = k % 3 == 0
    rows = inv(spark, d).select(
        "invoice_id",
        F.when(k % 2 == 0, " Tienda ").otherwise("  ").alias("nombre_comercial"),
        F.when(~none, "Ana").otherwise(" ").alias("nombre"),
        F.lit("").alias("primer_apellido"),
        F.when(~none, F.col("name")).alias("segundo_apellido"),
        F.when(k % 4 == 1, "No Aplica").when(k % 4 == 3, " Otra no especificada en el catálogo ").otherwise(F.col("segment")).alias("colonia"),
    )
    return screening.certificate_defaults(rows).select("invoice_id", "nombre_comercial", "colonia")


@query("clabe_keys", with_ctes(INV) + """
, c AS (SELECT invoice_id, CASE invoice_id % 3 WHEN 0 THEN lpad(invoice_id::VARCHAR, 18, '9') WHEN 1 THEN lpad(invoice_id::VARCHAR, 15, '3') ELSE '' END AS n, invoice_id % 2 = 0 AS amex FROM inv)
SELECT invoice_id, CASE WHEN n = '' THEN NULL WHEN amex THEN n ELSE lpad(n, 18, '0') END AS clabe,
 CASE WHEN length(n) = 18 THEN concat(n, ',', right(n, 10), ',', right(n, 11)) ELSE n END AS keys FROM c""")
def clabe_keys(spark, d):
    k, text = F.col("invoice_id"), F.col("invoice_id").cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit("9-"), F.lpad(text, 17, "9"))).when(k % 3 == 1, F.concat(F.lit("3 "), F.lpad(text, 14, "3"))).otherwise("sin")
    bank = F.when(k % 2 == 0, "American Express").otherwise("bbva")
    return inv(spark, d).select(
        "invoice_id", ids.normalize_clabe(raw, bank).alias("clabe"), F.array_join(ids.account_keys(raw), ",").alias("keys")
    )


@query("assemble_description", with_ctes(TX) + """
SELECT mov_id, CASE order_key % 5 WHEN 0 THEN concat('b', line_no, ' c d') WHEN 1 THEN concat('b', line_no, ' e') WHEN 2 THEN concat('c e b', line_no) WHEN 3 THEN concat('b', line_no) ELSE '' END AS description,
 CASE order_key % 5 WHEN 0 THEN 'e' WHEN 1 THEN 'd' WHEN 2 THEN 'd' WHEN 3 THEN 'e' ELSE '0.0' END AS amount FROM tx""")
def assemble_description(spark, d):
    k = F.col("order_key") % 5
    bank = F.when(k == 0, "Banorte").when(k == 1, "BBVA").when(k == 2, "mifel").when(k == 3, "banregio").otherwise("otro")
    parts = F.array(F.lit("a"), F.concat(F.lit("b"), F.col("line_no").cast("string")), F.lit("c"), F.lit("d"), F.lit("e"))
    return mov(spark, d).select("mov_id", parse.assemble_parts(parts, bank).alias("p")).select("mov_id", "p.description", "p.amount")


@query("coerce_schema", with_ctes(INV) + """
SELECT invoice_id, counterparty::VARCHAR AS rfc, CASE invoice_id % 3 WHEN 0 THEN CAST(total AS DOUBLE) WHEN 1 THEN 0 ELSE CAST(total AS DOUBLE) END AS deposits FROM inv""")
def coerce_schema(spark, d):
    k = F.col("invoice_id") % 3
    rows = inv(spark, d).select(
        "invoice_id", F.col("counterparty").alias("rfc"),
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(F.col("total"), 2))).when(k == 1, "n/d").otherwise(F.col("total").cast("string")).alias("deposits"),
    )
    return reconcile.coerce_fields(rows, ["rfc", "missing"], ["deposits"]).select("invoice_id", "rfc", "deposits")


@query("mop_counts", with_ctes(TX) + """
, h AS (SELECT mov_id, concat(repeat('1', line_no), 'LC', quantity, '-U', order_key, 'LCU') AS h FROM tx), r AS (SELECT mov_id, h, replace(h, 'LC', '') AS q FROM h)
SELECT mov_id, (length(q) - length(replace(q, '1', '')))::BIGINT AS mop_1, (length(q) - length(replace(q, '9', '')))::BIGINT AS mop_9, (length(q) - length(replace(q, '0', '')))::BIGINT AS mop_0,
 (length(q) - length(replace(q, 'U', '')))::BIGINT AS mop_u, (length(q) - length(replace(q, '-', '')))::BIGINT AS mop_nd, ((length(h) - length(q)) / 2)::BIGINT AS mop_lc FROM r""")
def mop_counts(spark, d):
    history = F.concat(
        F.repeat(F.lit("1"), F.col("line_no")), F.lit("LC"), F.col("quantity").cast("string"), F.lit("-U"), F.col("order_key").cast("string"), F.lit("LCU")
    )
    return mov(spark, d).select("mov_id", parse.mop_counts(history).alias("m")).select(
        "mov_id", "m.mop_1", "m.mop_9", "m.mop_0", "m.mop_u", "m.mop_nd", "m.mop_lc"
    )


@query("code_labels", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 4 WHEN 0 THEN 'Línea de Crédito' WHEN 1 THEN 'Crédito Automotriz' WHEN 2 THEN '9999' END AS account_type,
 CASE status WHEN 'paid' THEN 'Definitivo' WHEN 'open' THEN 'Presunto' ELSE status END AS status, CASE invoice_id % 2 WHEN 0 THEN 'MXN' ELSE 'USD' END AS currency FROM inv""")
def code_labels(spark, d):
    k = F.col("invoice_id")
    code = F.when(k % 4 == 0, "6280").when(k % 4 == 1, "6270").when(k % 4 == 2, "9999")
    status = F.when(F.col("status") == "paid", "definitive").when(F.col("status") == "open", "presumed").otherwise(F.col("status"))
    return inv(spark, d).select(
        "invoice_id", parse.label_of(code, catalog.CREDIT_TYPES).alias("account_type"),
        parse.label_of(status, catalog.BLACKLIST_STATUS).alias("status"),
        parse.label_of(F.when(k % 2 == 0, "001").otherwise("USD"), catalog.CURRENCIES).alias("currency"),
    )


class _Terms:
    """Provider rules of words that occur in the driver tables."""

    AGGREGATORS = {"UNO": ("red. ring", "hot bolt"), "DOS": ("widget",)}
    BANK_TERMS = {"BBVA": ("anvil", "promo"), "HSBC": ("gear",)}
    TERMINAL_NUMBER_BANK = "BANORTE"
    TERMINAL_NUMBER_PATTERN = r"\b\d{2}[a-z]\b"
    TERMINAL_NUMBER_NAME = "BANORTE TERMINAL"
    UNKNOWN_PROVIDER = "NO DEFINIDA"


@query("terminal_provider", with_ctes(TX) + """
, b AS (SELECT mov_id, concat(description, CASE WHEN line_no = 1 THEN ' 77c' ELSE '' END) AS t, CASE order_key % 4 WHEN 0 THEN 'BANORTE' WHEN 1 THEN 'BBVA' WHEN 2 THEN 'HSBC' ELSE 'OTRO' END AS bank FROM tx)
SELECT mov_id, CASE WHEN bank = 'BANORTE' AND regexp_matches(t, '\\b\\d{2}[a-z]\\b') THEN 'BANORTE TERMINAL' WHEN contains(t, 'red ring') OR contains(t, 'hot bolt') THEN 'UNO' WHEN contains(t, 'widget') THEN 'DOS'
 WHEN bank = 'BBVA' AND (contains(t, 'anvil') OR contains(t, 'promo')) THEN 'BBVA' WHEN bank = 'HSBC' AND contains(t, 'gear') THEN 'HSBC' ELSE 'NO DEFINIDA' END AS provider FROM b""")
def terminal_provider(spark, d):
    k = F.col("order_key") % 4
    bank = F.when(k == 0, "banorte ").when(k == 1, "BBVA").when(k == 2, "hsbc").otherwise("otro")
    text = F.concat("description", F.when(F.col("line_no") == 1, " 77-C").otherwise(""))
    rows = mov(spark, d).select("mov_id", bank.alias("bank"), X.fold_plain(text).alias("text"))
    return rows.select("mov_id", bank_lines.terminal_provider(F.col("bank"), F.col("text"), _Terms).alias("provider"))


@query("date_display", with_ctes(INV) + "SELECT invoice_id, concat(month(issued), '/', day(issued), '/', year(issued)) AS us, strftime(issued, '%b-%y') AS short FROM inv")
def date_display(spark, d):
    return inv(spark, d).select("invoice_id", D.short_us_date(F.col("issued")).alias("us"), D.month_label(F.col("issued")).alias("short"))


@query("sentinels_to_null", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 5 < 4 THEN NULL ELSE segment END AS value FROM inv""")
def sentinels_to_null(spark, d):
    k = F.col("invoice_id") % 5
    raw = F.when(k == 0, "NULL").when(k == 1, " N/A ").when(k == 2, "").when(k == 3, "None").otherwise(F.col("segment"))
    return inv(spark, d).select("invoice_id", X.null_if_sentinel(raw).alias("value"))


@query("identity_alert", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 4 WHEN 0 THEN 'Extracción de identidad incompleta: No se pudo localizar RFC ni Nombre.' WHEN 1 THEN 'Extracción de identidad incompleta: No se pudo localizar Nombre.'
 WHEN 2 THEN 'Extracción de identidad incompleta: No se pudo localizar RFC.' END AS alert FROM inv""")
def identity_alert(spark, d):
    k = F.col("invoice_id") % 4
    return inv(spark, d).select("invoice_id", ids.identity_alert(F.when(k % 2 == 1, "R"), F.when(k >= 2, F.col("name"))).alias("alert"))


@query("lookback_filter", with_ctes(INV) + """
SELECT invoice_id, issued >= DATE '2001-08-15' - 365 AS year, issued >= DATE '2000-08-01' AS full_months FROM inv WHERE issued BETWEEN DATE '2001-08-15' - 730 AND DATE '2001-08-15'""")
def lookback_filter(spark, d):
    rows = inv(spark, d).filter(D.in_lookback(F.col("issued"), AS_OF, 730))
    return rows.select("invoice_id", D.in_lookback(F.col("issued"), AS_OF, 365).alias("year"), D.in_full_months(F.col("issued"), AS_OF).alias("full_months"))


@query("closed_months", with_ctes(INV) + "SELECT invoice_id, issued::VARCHAR AS issued FROM inv WHERE date_trunc('month', issued) <> DATE '2001-07-01'")
def closed_months(spark, d):
    return inv(spark, d).filter(D.closed_months(F.col("issued"), "2001-07-10")).select("invoice_id", "issued")


@query("parse_fenced_json", """
SELECT event_id, event_type AS description, value::VARCHAR AS amount, CASE WHEN user_id % 3 = 0 THEN 'INDEFINIDO' ELSE 'ABONO' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'GENERAL' ELSE 'x' END AS category
FROM events WHERE event_id % 4 <> 3""")
def parse_fenced_json(spark, d):
    ev = A.table(spark, d, "events")
    user = F.col("user_id")
    body = F.concat(
        F.lit('[{"fecha": "f", "descripcion": "'), "event_type", F.lit('", "monto": "'), F.col("value").cast("string"), F.lit('"'),
        F.when(user % 3 != 0, ', "tipo": "abono"').otherwise(""), F.when(user % 2 != 0, ', "categoria": "x"').otherwise(""), F.lit("}]"),
    )
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("ok ```json\n"), body, F.lit("\n``` fin")))
        .when(k == 1, F.concat(F.lit("<scratchpad>[1]</scratchpad> "), body)).when(k == 2, F.concat(F.lit("Sure: "), body, F.lit(" end"))).otherwise("none")
    )
    return ev.select("event_id", F.explode(parse.fenced_rows(text)).alias("r")).select("event_id", "r.description", "r.amount", "r.kind", "r.category")
