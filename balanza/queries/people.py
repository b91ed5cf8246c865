"""Bureau reports, KYC, registries, risk tables and nested JSON feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.operators import credit, reports, risk, screening
from balanza.queries.registry import AS_OF, INV, query, with_ctes
from balanza.sources import adapters as A


def inv(spark, d):
    return A.invoices(spark, d)


_RAW = """raw AS (SELECT taxpayer AS report_id, invoice_id AS line_id, CASE invoice_id % 3 WHEN 0 THEN '6280' WHEN 1 THEN '1380' ELSE '9999' END AS code, CASE WHEN status = 'cancelled' THEN 0 ELSE total END AS balance, total * 2 AS initial_balance,
 CASE WHEN invoice_id % 3 = 0 THEN CAST(total * 0.1 AS DECIMAL(18,2)) END AS stated, CASE WHEN invoice_id % 5 <> 0 THEN issued END AS opened, (invoice_id % 10) * 90 AS term_days, CASE WHEN status = 'paid' THEN '2001-01-01' WHEN status = 'open' THEN 'N/A' END AS closed, invoice_id % 6 AS k, CAST(total * 0.05 AS DECIMAL(18,2)) AS due FROM inv),
lines AS (SELECT *, CASE WHEN code = '6280' THEN 'Línea de Crédito' WHEN code = '1380' THEN 'Tarjeta de Crédito empresarial / Corporativa' ELSE code END AS account_type, coalesce(stated, due) AS past_due,
 CASE WHEN opened IS NOT NULL AND term_days > 0 THEN opened + CAST(term_days AS INT) END AS final_date, balance::DOUBLE / (sum(balance) OVER (PARTITION BY report_id))::DOUBLE AS weight FROM raw),
left_days AS (SELECT *, CASE WHEN final_date >= DATE '2001-08-15' THEN final_date - DATE '2001-08-15' ELSE 0 END AS days_left FROM lines),
cl AS (SELECT *, round_even(weight * days_left, 0) AS weighted_days, CASE WHEN balance <= 0 THEN 0 WHEN days_left < 30.4 THEN balance::DOUBLE ELSE balance::DOUBLE / (days_left / 30.4::DOUBLE) END AS monthly_payment FROM left_days)"""


def _lines(spark, d):
    k, total = F.col("invoice_id"), F.col("total")
    zero = F.lit(0).cast("decimal(18,2)")
    due = (total / 20).cast("decimal(18,2)")
    raw = inv(spark, d).select(
        F.col("taxpayer").alias("report_id"), k.alias("line_id"), F.lit(AS_OF).cast("date").alias("report_date"),
        F.when(k % 3 == 0, "6280").when(k % 3 == 1, "1380").otherwise("9999").alias("code"),
        F.when(F.col("status") == "cancelled", zero).otherwise(total).alias("balance"), (total * 2).cast("decimal(18,2)").alias("initial_balance"),
        F.when(k % 3 == 0, (total / 10).cast("decimal(18,2)")).alias("stated_past_due"), F.when(k % 5 != 0, F.col("issued")).alias("opened"),
        ((k % 10) * 90).cast("int").alias("term_days"), F.when(F.col("status") == "paid", "2001-01-01").when(F.col("status") == "open", "N/A").alias("closed"),
        *[F.when(k % 6 == i, due).otherwise(zero).alias(f"due_{b}") for i, b in enumerate(credit.PAST_DUE_BUCKETS)],
    )
    return credit.credit_lines(raw)


@query("credit_lines", with_ctes(INV, _RAW) + """
SELECT report_id, line_id, account_type, CAST(past_due AS DOUBLE) AS past_due, final_date::VARCHAR AS final_date, round(weight, 8) AS weight, days_left::BIGINT AS days_left, weighted_days, round(monthly_payment, 4) AS monthly_payment FROM cl""")
def credit_lines(spark, d):
    return _lines(spark, d).select(
        "report_id", "line_id", "account_type", "past_due", "final_date", F.round("weight", 8).alias("weight"), "days_left", "weighted_days",
        F.round("monthly_payment", 4).alias("monthly_payment"),
    )


_SUMMARY = """summ AS (SELECT report_id, coalesce(sum(initial_balance) FILTER (coalesce(closed, '') IN ('', 'None', 'N/A')), 0)::DOUBLE AS open_initial, sum(balance)::DOUBLE AS balance, sum(past_due)::DOUBLE AS past_due,
 coalesce(sum(past_due) FILTER (coalesce(closed, '') IN ('', 'None', 'N/A')), 0)::DOUBLE AS open_past_due, round(sum(CAST(monthly_payment AS DECIMAL(28,6)))::DOUBLE, 3) AS monthly_payment_1,
 CASE WHEN sum(weighted_days) > 0 THEN round(sum(weighted_days) / 360, 2) ELSE 0 END AS term_years FROM cl GROUP BY report_id)"""


@query("credit_summary", with_ctes(INV, _RAW, _SUMMARY) + """
SELECT s.*, round(CASE WHEN term_years > 0 THEN balance / term_years / 12 ELSE 0 END, 3) AS monthly_payment_2, CASE report_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 ELSE 0 END::DOUBLE AS trend_pct,
 CASE report_id % 3 WHEN 0 THEN 'Han ido aumentando sus consultas' WHEN 1 THEN 'Han ido disminuyendo sus consultas' ELSE 'Estables' END AS trend_text FROM summ s""")
def credit_summary(spark, d):
    lines = _lines(spark, d)
    k = F.col("report_id") % 3
    trend = lines.select("report_id").distinct().select("report_id", F.when(k == 0, 0.5).when(k == 1, -0.25).alias("trend_pct"))
    out = credit.credit_summary(lines, trend)
    return out.withColumns({"monthly_payment_1": F.round("monthly_payment_1", 3), "monthly_payment_2": F.round("monthly_payment_2", 3)})


@query("past_due_buckets", with_ctes(INV, _RAW) + """
, names AS (SELECT * FROM (VALUES (0, '1_29'), (1, '30_59'), (2, '60_89'), (3, '90_119'), (4, '120_179'), (5, '180_plus')) x(j, bucket)),
b AS (SELECT report_id, bucket, sum(CASE WHEN k = j THEN due ELSE 0 END)::DOUBLE AS amount FROM raw, names GROUP BY ALL),
t AS (SELECT report_id, sum(balance)::DOUBLE AS total FROM raw GROUP BY ALL)
SELECT b.report_id, bucket, amount, round(amount / total, 4) AS share FROM b JOIN t ON b.report_id = t.report_id""")
def past_due_buckets(spark, d):
    return credit.past_due_buckets(_lines(spark, d))


@query("credit_detail", with_ctes(INV, _RAW) + """
SELECT report_id, line_id, account_type, concat(month(opened), '/', day(opened), '/', year(opened)) AS opened_shown, coalesce(CASE WHEN final_date IS NULL THEN NULL ELSE concat(month(final_date), '/', day(final_date), '/', year(final_date)) END, '') AS final_shown,
 coalesce(strftime(opened, '%b-%y'), 'N/A') AS mop_month FROM cl""".replace("concat(month(opened), '/', day(opened), '/', year(opened)) AS", "CASE WHEN opened IS NOT NULL THEN concat(month(opened), '/', day(opened), '/', year(opened)) END AS"))
def credit_detail(spark, d):
    return reports.credit_detail(_lines(spark, d)).select("report_id", "line_id", "account_type", "opened_shown", "final_shown", "mop_month")


@query("inquiry_summary", with_ctes(INV) + """
, c AS (SELECT taxpayer AS report_id, pay_type AS kind, count(*) FILTER (year(issued) < 1998) AS over_24, count(*) FILTER (year(issued) >= 1998) AS last_24, count(*) FILTER (year(issued) >= 2000) AS last_12, count(*) FILTER (year(issued) >= 2001 AND taxpayer <> 3) AS last_3 FROM inv GROUP BY ALL),
a AS (SELECT *, last_24 / 24.0::DOUBLE AS a24, last_12 / 12.0::DOUBLE AS a12, last_3 / 3.0::DOUBLE AS a3 FROM c)
SELECT report_id, kind, 'over_24' AS span, over_24 AS quantity, NULL::DOUBLE AS months, NULL::DOUBLE AS monthly_average, NULL::DOUBLE AS growth FROM a UNION ALL SELECT report_id, kind, 'last_24', last_24, 24, round(a24, 2), NULL FROM a
UNION ALL SELECT report_id, kind, 'last_12', last_12, 12, round(a12, 2), round(CASE WHEN a24 > 0 THEN a12 / a24 - 1 ELSE 0 END, 4) FROM a UNION ALL SELECT report_id, kind, 'last_3', last_3, 3, round(a3, 2), round(CASE WHEN a12 > 0 THEN a3 / a12 - 1 ELSE 0 END, 4) FROM a""")
def inquiry_summary(spark, d):
    y = F.year("issued")
    counters = inv(spark, d).groupBy(F.col("taxpayer").alias("report_id"), F.col("pay_type").alias("kind")).agg(
        F.count_if(y < 1998).alias("over_24"), F.count_if(y >= 1998).alias("last_24"), F.count_if(y >= 2000).alias("last_12"),
        F.count_if((y >= 2001) & (F.col("taxpayer") != 3)).alias("last_3"),
    )
    return credit.inquiry_summary(counters)


@query("bureau_inquiries", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 3 WHEN 0 THEN name WHEN 1 THEN segment ELSE 'N/A' END AS institution, CASE WHEN invoice_id % 2 = 0 THEN 'Seguros' ELSE 'N/A' END AS contract_type, issued::VARCHAR AS inquiry_date, total::DOUBLE AS amount FROM inv""")
def bureau_inquiries(spark, d):
    k = F.col("invoice_id")
    rows = inv(spark, d).select(
        "invoice_id", F.when(k % 3 == 0, F.col("name")).otherwise("").alias("grantor"), F.when(k % 3 == 1, F.col("segment")).alias("user_type"),
        F.when(k % 2 == 0, "6290").alias("contract_code"), F.date_format("issued", "ddMMyyyy").alias("raw_date"), F.concat(F.col("total").cast("string"), F.lit("+")).alias("raw_amount"),
    )
    return credit.bureau_inquiries(rows).select("invoice_id", "institution", "contract_type", "inquiry_date", "amount")


@query("bureau_normalize", with_ctes(INV) + """
SELECT invoice_id, CASE invoice_id % 2 WHEN 0 THEN 'company' ELSE 'person' END AS shape, CASE invoice_id % 2 WHEN 0 THEN concat('7', invoice_id % 10) ELSE concat('6', invoice_id % 10) END AS score, 2 AS lines, 1 AS inquiries FROM inv""")
def bureau_normalize(spark, d):
    k = F.col("invoice_id")
    digit, total = (k % 10).cast("string"), F.col("total").cast("string")
    company = F.concat(
        F.lit('{"score":[{"valorScore":7'), digit, F.lit('}],"creditoFinanciero":[{"saldo":'), total, F.lit('},{"saldo":1}],"historialConsultas":{"tipo":"x"}}')
    )
    person = F.concat(
        F.lit('{"score":"6'), digit, F.lit('","respuesta":{"persona":{"cuentas":[{"saldo":'), total, F.lit('},{}],"consultaEfectuadas":[{"tipo":"y"}]}}}')
    )
    rows = inv(spark, d).select("invoice_id", F.parse_json(F.when(k % 2 == 0, company).otherwise(person)).alias("body"))
    return credit.bureau_normalize(rows).select("invoice_id", "shape", "score", F.size("lines").alias("lines"), F.size("inquiries").alias("inquiries"))


@query("kyc_checks", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 5 = 0 THEN NULL ELSE issued >= DATE '2001-05-15' END AS recent_proof, CASE invoice_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same_rfc, CASE WHEN invoice_id % 2 = 0 THEN invoice_id % 4 = 0 END AS same_qr FROM inv""")
def kyc_checks(spark, d):
    k = F.col("invoice_id")
    rows = inv(spark, d).select(
        "invoice_id", F.when(k % 5 == 0, "2001/05").otherwise(F.col("issued").cast("string")).alias("proof_end"), F.lit("abc010101xy1").alias("payroll_rfc"),
        F.when(k % 3 == 0, "ABC010101XY1").when(k % 3 == 1, "ZZZ010101XY1").otherwise("").alias("statement_rfc"),
        F.when(k % 2 == 0, "q-A").alias("payroll_qr"), F.when(k % 4 == 0, "Q-a").otherwise("q-b").alias("payroll2_qr"),
    )
    return screening.kyc_checks(rows, AS_OF).select("invoice_id", "recent_proof", "same_rfc", "same_qr")


@query("kyc_merge", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN 'code' ELSE segment END AS datos_qr, CASE invoice_id % 3 WHEN 0 THEN concat('R', invoice_id) WHEN 1 THEN 'A' ELSE 'model' END AS rfc, CASE WHEN invoice_id % 3 = 0 THEN 'C' END AS curp,
 CASE invoice_id % 4 WHEN 0 THEN true WHEN 1 THEN invoice_id % 3 = 0 WHEN 2 THEN true ELSE true END AS good FROM inv""")
def kyc_merge(spark, d):
    k = F.col("invoice_id")
    none = F.array().cast("array<string>")
    kind = F.when(k % 4 == 0, "nomina").when(k % 4 == 1, "comprobante").when(k % 4 == 2, "estado").otherwise("otro")
    rows = inv(spark, d).select(
        "invoice_id", kind.alias("doc_type"), F.when(k % 2 == 0, "code").otherwise("").alias("qr"), F.col("segment").alias("datos_qr"),
        F.when(k % 3 == 0, F.array(F.lit("A"), F.concat(F.lit("R"), k.cast("string")))).when(k % 3 == 1, F.array(F.lit("A"))).otherwise(none).alias("rfc_found"),
        F.when(k % 3 == 0, F.array(F.lit("C"))).otherwise(none).alias("curp_found"), F.lit("model").alias("rfc"), F.lit(None).cast("string").alias("curp"),
        F.lit("x").alias("nombre"), F.lit("").alias("salario_neto"), F.lit("5").alias("total_percepciones"), F.lit("").alias("clabe"), F.lit("").alias("numero_cuenta"),
        F.lit(None).cast("string").alias("domicilio"), F.when(k % 3 == 0, "2001").alias("inicio_periodo"),
    )
    return screening.kyc_merge(rows).select("invoice_id", "datos_qr", "rfc", "curp", screening.kyc_quality(F.col("doc_type")).alias("good"))


# Registries: one record per customer, with partners and acts.
def _registry(spark, d):
    c = A.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = k.cast("string")
    partners = F.concat(
        F.lit('[{"nombre":"Ana","apellidoPaterno":"P'), text, F.lit('","acciones":"10","valor":"'), F.col("c_acctbal").cast("string"), F.lit('","estatus":"ok"}'),
        F.when(k % 2 == 0, F.lit(',{"valor":"x"}')).otherwise(""), F.lit("]"),
    )
    act = F.when(k % 3 == 0, F.lit('"actos":[{"fechaDeIngreso":"2001-02-03T00:00","acto":"alta","numeroDeDocumento":"7"}]')).otherwise(F.lit('"acto":[]'))
    body = F.concat(
        F.lit('{"fme":"F'), text, F.lit('","fechaDeInscripcion":"2000-01-02T10:00","nombreRazonSocial":"'), "c_name", F.lit('",'),
        F.when(k % 2 == 0, F.lit('"socios":')).otherwise(F.lit('"socio":')), partners, F.lit(","), act, F.lit("}"),
    )
    return risk.registry_records(c.select(k.alias("customer"), F.parse_json(body).alias("body")), "customer")


@query("registry_partners", """
SELECT c_custkey AS customer, concat('F', c_custkey) AS folio, concat('Ana P', c_custkey) AS name, '10' AS shares, c_acctbal AS value, 'ok' AS status FROM customer UNION ALL SELECT c_custkey, concat('F', c_custkey), 'N/A', 'N/A', 0, 'N/A' FROM customer WHERE c_custkey % 2 = 0""")
def registry_partners(spark, d):
    return risk.registry_partners(_registry(spark, d), "customer")


@query("registry_acts", "SELECT c_custkey AS customer, concat('F', c_custkey) AS folio, '2001-02-03' AS date, 'alta' AS description, '7' AS document_number FROM customer WHERE c_custkey % 3 = 0")
def registry_acts(spark, d):
    return risk.registry_acts(_registry(spark, d), "customer")


@query("registry_guarantees", """
SELECT c_custkey AS customer, concat('G', c_custkey) AS guarantee_number, '2001-03-04' AS created, 'N/A' AS validity, c_name AS creditor, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1000 + c_custkey % 1000 + 0.5 END::DOUBLE AS amount,
 CASE c_custkey % 4 WHEN 1 THEN 'USD' ELSE 'MXN' END AS currency, 'Inscripcion uno' AS status FROM customer""")
def registry_guarantees(spark, d):
    k = F.col("c_custkey")
    amount = F.concat(F.lit("$ 1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5 "), F.when(k % 4 == 1, "Dolar americano").otherwise("Peso Mexicano"))
    note = F.when(k % 4 == 3, F.lit('"datos_de_la_garantia_mobiliaria":{}')).otherwise(
        F.concat(F.lit('"datos_de_la_garantia_mobiliaria":{"monto_maximo_garantizado_y_moneda":"'), amount, F.lit('"}'))
    )
    body = F.concat(
        F.lit('{"numeroDeGarantia":"G'), k.cast("string"), F.lit('","fecha":"2001-03-04T00:00","tipo":"INSCRIPCION uno","boleta":{"datos_del_acreedor":{"nombre_denominacion_o_razon_social":"'), "c_name",
        F.lit('"},'), note, F.lit("}}"),
    )
    return risk.registry_guarantees(A.table(spark, d, "customer").select(k.alias("customer"), F.parse_json(body).alias("body")), "customer")


@query("obligations", """
SELECT c_custkey AS customer, concat('ISR ', c_mktsegment) AS tax, '2001-01' AS periods FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'IVA', 'N/A' FROM customer WHERE c_custkey % 2 = 0""")
def obligations(spark, d):
    k = F.col("c_custkey")
    body = F.when(k % 2 == 0, F.concat(F.lit('{"obligaciones_omitidas":[{"impuesto":"ISR '), "c_mktsegment", F.lit('","periodos":"2001-01"},{"impuesto":"IVA"}]}'))).otherwise(F.lit("{}"))
    return risk.obligations(A.table(spark, d, "customer").select(k.alias("customer"), F.parse_json(body).alias("body")), "customer")


@query("activities", with_ctes(INV) + """
SELECT invoice_id, CASE WHEN invoice_id % 4 = 0 THEN 'N/A' ELSE segment END AS name, CASE WHEN invoice_id % 3 = 0 THEN 0 ELSE date_diff('year', issued, DATE '2001-08-15') - CASE WHEN strftime(issued, '%m%d') > '0815' THEN 1 ELSE 0 END END AS seniority_years FROM inv""")
def activities(spark, d):
    k = F.col("invoice_id")
    rows = inv(spark, d).select(
        "invoice_id", F.when(k % 4 != 0, F.col("segment")).alias("name"),
        F.when(k % 3 == 0, "desde siempre").otherwise(F.concat(F.col("issued").cast("string"), F.lit("T00:00:00Z"))).alias("start_date"),
    )
    return risk.activities(rows, AS_OF).select("invoice_id", "name", "seniority_years")


# Small JSON built from events.
def _events(spark, d, body):
    return A.table(spark, d, "events").select("event_id", F.parse_json(body).alias("body"))


@query("unwrap_members", """
SELECT event_id, i AS k FROM events, LATERAL (SELECT unnest([1, 2]) AS i) u WHERE event_id % 5 < 4""")
def unwrap_members(spark, d):
    k = F.col("event_id") % 5
    items = F.lit('[{"k":1},{"k":2}]')
    body = (
        F.when(k == 0, items).when(k == 1, F.concat(F.lit('{"hydra:member":'), items, F.lit("}"))).when(k == 2, F.concat(F.lit('{"hydra:member":[],"data":'), items, F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"respuesta":'), items, F.lit("}"))).otherwise(F.lit('{"x":1}'))
    )
    rows = _events(spark, d, body).select("event_id", F.explode(risk.members(F.col("body"))).alias("m"))
    return rows.select("event_id", F.try_variant_get("m", "$.k", "bigint").alias("k"))


@query("risk_indicators", """
SELECT event_id, 'a' AS indicator, event_type AS value, CASE WHEN user_id % 2 = 0 THEN 'SÍ' ELSE 'NO' END AS risky FROM events UNION ALL SELECT event_id, 'b', NULL, 'NO' FROM events""")
def risk_indicators(spark, d):
    risky = F.when(F.col("user_id") % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    body = F.concat(F.lit('{"data":[{"a":{"value":"'), "event_type", F.lit('","risky":'), risky, F.lit('},"b":{"risky":null},"c":5}]}'))
    return risk.risk_indicators(_events(spark, d, body), "event_id")


@query("kv_rows", """
SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'none', 'None' FROM events""")
def kv_rows(spark, d):
    number = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"k":'), number, F.lit(',"type":"'), "event_type", F.lit('","none":null,"list":[1],"deep":{"x":1}}'))
    return risk.kv_rows(_events(spark, d, body), "event_id")


@query("list_rows", """
SELECT event_id, event_type AS a, '' AS b FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'z', '2' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'u', 'v' FROM events WHERE event_id % 3 = 2""")
def list_rows(spark, d):
    k = F.col("event_id") % 3
    one = F.concat(F.lit('{"a":"'), "event_type", F.lit('"}'))
    body = F.when(k == 0, F.concat(F.lit("["), one, F.lit(',{"a":"z","b":2}]'))).when(k == 1, one).otherwise(F.lit('{"p":{"a":"u","b":"v"}}'))
    return risk.list_rows(_events(spark, d, body), "event_id", ["a", "b"])
