"""Statement analytics: classification, own transfers, totals, quality, dedup, cover checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from balanza.functions import ids, money
from balanza.operators import classify as C, dedup, own_transfer as O, ordered, reconcile, reports, screening, totals as T
from balanza.queries.registry import COVER, TX, query, with_ctes
from balanza.rules.tags import TagRule
from balanza.session import checkpoint_root, cut
from balanza.sources import adapters as A, results

# A small rule set of words that occur in the driver tables, one keyword list per shipped tag.
RULES = (
    TagRule("EXCLUIDA", 9999, ("old",)),
    TagRule("IVA", 1000, ("promo",)),
    TagRule("COMISION_CR", 100, ("red ring",)),
    TagRule("COMISION_DB", 100, ("blue", "blue ring")),
    TagRule("COMISION_AMEX", 100, ("hot r",)),
    TagRule("COMISION_MIXTA", 90, ("red", "rod")),
    TagRule("TPV", 80, ("widget",)),
    TagRule("FINANCIAMIENTO", 50, ("gear",)),
    TagRule("PAGO_FINANCIAMIENTO", 50, ("anvil",)),
    TagRule("TRASPASO", 40, ("bolt",)),
    TagRule("EFECTIVO", 30, ("ring",)),
    TagRule("BMRCASH", 30, ("cold",)),
    TagRule("MORATORIOS", 20, ("plate",)),
)

_WEIGHTS = {r.tag: r.weight for r in RULES}
_FLAGS = ", ".join(
    "(" + " OR ".join(f"contains(description, '{k}')" for k in r.keywords) + f") AS t_{r.tag.lower()}" for r in RULES
)
_HEAVY = ["financiamiento", "pago_financiamiento", "traspaso", "efectivo", "bmrcash", "moratorios"]


def _case(value) -> str:
    def why(tag):
        return f"'Resolución heurística: Gana el Tag ''{tag}'' con peso de {_WEIGHTS[tag]} puntos.'"

    def fee(tag):
        return f"'Regla de supremacía: Comisión detectada ({tag}).'"

    free = "NOT is_in AND NOT (t_traspaso OR t_bmrcash)"
    steps = [
        ("kind = 'importe'", "'BASURA_OCR'", "'Descarte automático: Identificado como Basura OCR / CFDI.'"),
        ("NOT is_in AND t_pago_financiamiento", "'PAGO_FINANCIAMIENTO'",
         "'Defensa de cargos: Pago a financiamiento tiene prioridad máxima.'"),
        (f"{free} AND t_iva", "'IVA'", "'Regla de supremacía: IVA mata cualquier otra categoría.'"),
        *[(f"{free} AND t_{t.lower()}", f"'{t}'", fee(t)) for t in ("COMISION_CR", "COMISION_DB", "COMISION_AMEX", "COMISION_MIXTA")],
        ("t_excluida", "'GENERAL'", "'Muerte Súbita: Contiene palabra en lista de exclusiones.'"),
        ("t_tpv", "'TPV'", "'Matriz de conflictos: TPV tiene prioridad sobre financiamientos/traspasos.'"),
        ("t_financiamiento", "CASE WHEN is_in THEN 'FINANCIAMIENTO' ELSE 'PAGO_FINANCIAMIENTO' END", why("FINANCIAMIENTO")),
        ("t_pago_financiamiento", "'PAGO_FINANCIAMIENTO'", why("PAGO_FINANCIAMIENTO")),
        ("t_traspaso", "CASE WHEN is_in THEN 'TRASPASO_ABONO' ELSE 'TRASPASO_CARGO' END", why("TRASPASO")),
        *[(f"t_{t.lower()}", f"'{t}'", why(t)) for t in ("EFECTIVO", "BMRCASH", "MORATORIOS")],
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {(cat, why_)[value]}" for c, cat, why_ in steps) + " END"


TAGGED = f"tagged AS (SELECT *, kind = 'abono' AS is_in, {_FLAGS} FROM tx)"
RAW_CLASS = f"resolved AS (SELECT *, {_case(0)} AS cat0, {_case(1)} AS why0 FROM tagged)"
CLASS = """classified AS (SELECT *, coalesce(cat0, 'GENERAL') AS category,
 coalesce(why0, 'IA Fallback: No se pudo clasificar, asignado a GENERAL.') AS reason FROM resolved)"""
CLASSIFIED = (TX, TAGGED, RAW_CLASS, CLASS)


def classified(spark, d) -> DataFrame:
    return C.classify(A.movements(spark, d), RULES)


_TAG_ROWS = ", ".join(f"CASE WHEN t_{r.tag.lower()} THEN '{r.tag}:{r.weight}' END" for r in RULES)


@query("tag_movements", with_ctes(TX, TAGGED) + f"""
SELECT mov_id, concat_ws(',', {_TAG_ROWS}) AS tags FROM tagged""")
def tag_movements(spark, d):
    tagged = C.tag_movements(A.movements(spark, d), RULES)
    label = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["weight"].cast("string")))
    return tagged.select("mov_id", F.array_join(label, ",").alias("tags"))


@query("classify_movements", with_ctes(*CLASSIFIED) + "SELECT mov_id, category, reason FROM classified")
def classify_movements(spark, d):
    return classified(spark, d).select("mov_id", "category", "reason")


@query("merge_external_labels", """
SELECT d.doc_id,
 CASE WHEN contains(lower(d.text), 'promo') THEN 'IVA'
 WHEN l.doc_id IS NULL THEN 'GENERAL'
 WHEN l.quality = 1 AND l.toxic = 0 THEN CASE WHEN d.lang = 'en' THEN 'TRASPASO_ABONO' ELSE 'TRASPASO_CARGO' END
 WHEN l.quality = 0 AND l.toxic = 0 THEN CASE WHEN d.lang = 'en' THEN 'FINANCIAMIENTO' ELSE 'PAGO_FINANCIAMIENTO' END
 ELSE 'TPV' END AS category,
 CASE WHEN contains(lower(d.text), 'promo') THEN 'rule' WHEN l.doc_id IS NULL
 THEN 'IA Fallback: No se pudo clasificar, asignado a GENERAL.'
 ELSE 'Delegado a IA: Clasificación semántica en lote.' END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def merge_external_labels(spark, d):
    docs = A.table(spark, d, "documents")
    known = F.lower("text").contains("promo")
    rows = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", "abono").otherwise("cargo").alias("kind"),
        F.when(known, F.lit("IVA")).alias("category"),
        F.when(known, F.lit("rule")).alias("reason"),
    )
    word = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " Traspaso entre cuentas ")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "financiamiento")
        .otherwise("tpv")
    )
    labels = A.table(spark, d, "labels").select("doc_id", word.alias("label"))
    return C.merge_labels(rows, labels, "doc_id").select("doc_id", "category", "reason")


@query("balanced_batches", with_ctes(TX) + """
, placed AS (SELECT doc_id, mov_id, row_number() OVER (PARTITION BY doc_id ORDER BY posted, mov_id) AS pos,
 count(*) OVER (PARTITION BY doc_id) AS n FROM tx),
sized AS (SELECT *, CAST(ceil(n / ceil(n / 100.0)) AS BIGINT) AS batch_size FROM placed)
SELECT doc_id, mov_id, batch_size, CAST(floor((pos - 1) / batch_size) AS BIGINT) AS batch FROM sized""")
def balanced_batches(spark, d):
    mov = A.movements(spark, d).select("doc_id", "mov_id", "posted")
    block = F.trunc("posted", "month")
    return C.assign_batches(mov, "doc_id", ["posted", "mov_id"], block).select("doc_id", "mov_id", "batch_size", "batch")


@query("fee_subtype", with_ctes(TX) + """
SELECT mov_id, CASE WHEN line_no % 2 = 0 THEN 'TPV'
 WHEN regexp_matches(description || ' ' || lower(kind), '\\b(cr|cre|credito|red)\\b') AND false THEN ''
 WHEN regexp_matches(concat(description, CASE line_no WHEN 1 THEN ' cr' WHEN 3 THEN ' débito' WHEN 5 THEN ' amex' ELSE '' END), '\\b(cr|cre|credito)\\b') THEN 'COMISION_CR'
 WHEN line_no = 3 THEN 'COMISION_DB' WHEN line_no = 5 THEN 'COMISION_AMEX' ELSE 'COMISION_TPV_MIXTA' END AS category FROM tx""")
def fee_subtype(spark, d):
    mov = A.movements(spark, d)
    line = F.col("line_no")
    text = F.concat("description", F.when(line == 1, " cr").when(line == 3, " débito").when(line == 5, " amex").otherwise(""))
    cat = F.when(line % 2 == 0, F.lit("TPV")).otherwise(F.lit("COMISION_PENDIENTE"))
    return mov.select("mov_id", C.fee_subtype(cat, text).alias("category"))


@query("drop_junk", with_ctes(*CLASSIFIED) + "SELECT mov_id, kind, category FROM classified WHERE kind <> 'importe' AND category <> 'BASURA_OCR'")
def drop_junk(spark, d):
    return C.drop_junk(classified(spark, d)).select("mov_id", "kind", "category")


@query("detail_by_category", with_ctes(*CLASSIFIED) + """
SELECT doc_id, mov_id, posted::VARCHAR AS posted, description, CAST(amount AS DOUBLE) AS amount, category FROM classified
WHERE kind <> 'importe' AND category IN ('TPV', 'FINANCIAMIENTO', 'TRASPASO_ABONO')""")
def detail_by_category(spark, d):
    rows = C.by_category(C.drop_junk(classified(spark, d)), ["TPV", "FINANCIAMIENTO", "TRASPASO_ABONO"])
    return rows.select("doc_id", "mov_id", "posted", "description", "amount", "category")


@query("movement_sign", with_ctes(TX) + "SELECT mov_id, kind = 'abono' AS is_credit FROM tx")
def movement_sign(spark, d):
    return A.movements(spark, d).select("mov_id", money.is_credit(F.col("kind")).alias("is_credit"))


# Own transfers: accounts of a job are order numbers of its suppliers, padded to 18 digits.
_OWN = """pool AS (SELECT DISTINCT job_id, a AS account FROM (SELECT job_id, lpad(CAST(max(order_key) AS VARCHAR), 18, '7') AS c FROM tx GROUP BY doc_id, job_id) x,
 LATERAL (SELECT unnest([c, right(c, 10), right(c, 11)]) AS a) u),
texts AS (SELECT *, concat(description, ' cta ', right(lpad(CAST(order_key AS VARCHAR), 18, '7'), CASE WHEN line_no % 2 = 0 THEN 11 ELSE 9 END)) AS text FROM tx),
own AS (SELECT DISTINCT t.job_id, t.mov_id FROM (SELECT job_id, mov_id, unnest(regexp_extract_all(text, '\\b\\d{10,18}\\b')) AS n FROM texts) t
 JOIN pool p ON p.job_id = t.job_id AND p.account = t.n)"""


def _own_frames(spark, d):
    mov = A.movements(spark, d)
    clabe = F.lpad(F.max("order_key").cast("string"), 18, "7")
    cov = mov.groupBy("doc_id", "job_id").agg(clabe.alias("clabe"))
    tail = F.when(F.col("line_no") % 2 == 0, 11).otherwise(9)
    number = F.right(F.lpad(F.col("order_key").cast("string"), 18, "7"), tail)
    return mov.withColumn("description", F.concat("description", F.lit(" cta "), number)), cov


@query("own_transfer_account", with_ctes(TX, _OWN) + "SELECT job_id, mov_id FROM own")
def own_transfer_account(spark, d):
    mov, cov = _own_frames(spark, d)
    return O.own_by_account(mov, O.account_pool(cov))


@query("apply_own_transfer", with_ctes(TX, TAGGED, RAW_CLASS, CLASS, _OWN) + """
SELECT c.mov_id, o.mov_id IS NOT NULL AS suspicious,
 CASE WHEN o.mov_id IS NOT NULL AND category NOT IN ('TPV','EFECTIVO','BMRCASH','FINANCIAMIENTO','PAGO_FINANCIAMIENTO',
 'COMISION_CR','COMISION_DB','COMISION_AMEX','COMISION_TPV_MIXTA','MORATORIOS','IVA')
 THEN CASE WHEN is_in THEN 'TRASPASO_ABONO' ELSE 'TRASPASO_CARGO' END ELSE category END AS category
FROM classified c LEFT JOIN own o ON c.job_id = o.job_id AND c.mov_id = o.mov_id""")
def apply_own_transfer(spark, d):
    mov, cov = _own_frames(spark, d)
    own = O.own_by_account(mov, O.account_pool(cov))
    return O.apply_own(classified(spark, d), own).select("mov_id", "suspicious", "category")


@query("transfer_totals", with_ctes(TX, TAGGED, RAW_CLASS, CLASS, _OWN) + """
, marked AS (SELECT c.job_id, c.doc_id, c.amount, CASE WHEN o.mov_id IS NOT NULL AND category NOT IN ('TPV','EFECTIVO','BMRCASH','FINANCIAMIENTO','PAGO_FINANCIAMIENTO',
 'COMISION_CR','COMISION_DB','COMISION_AMEX','COMISION_TPV_MIXTA','MORATORIOS','IVA')
 THEN CASE WHEN is_in THEN 'TRASPASO_ABONO' ELSE 'TRASPASO_CARGO' END ELSE category END AS category
FROM classified c LEFT JOIN own o ON c.job_id = o.job_id AND c.mov_id = o.mov_id)
SELECT job_id, doc_id, CAST(sum(CASE WHEN category = 'TRASPASO_ABONO' THEN amount ELSE 0 END) AS DOUBLE) AS transfers_in,
 CAST(sum(CASE WHEN category = 'TRASPASO_CARGO' THEN amount ELSE 0 END) AS DOUBLE) AS transfers_out FROM marked GROUP BY ALL""")
def transfer_totals(spark, d):
    mov, cov = _own_frames(spark, d)
    own = O.own_by_account(mov, O.account_pool(cov))
    return O.transfer_totals(O.apply_own(classified(spark, d), own))


def _holders(spark, d):
    """A holder for each statement: the part that its first movement of a line 1 names."""
    mov = A.movements(spark, d).filter("line_no = 1")
    first = mov.groupBy("job_id", "doc_id").agg(F.min_by("description", F.struct("posted", "mov_id")).alias("description"))
    return first.select("job_id", F.concat(F.initcap(F.substring_index("description", " ", 2)), F.lit(" S de RL")).alias("holder"))


_HOLDERS = """names AS (SELECT DISTINCT job_id, regexp_extract(description, '^\\S+ \\S+') AS name FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id, doc_id ORDER BY posted, mov_id, description) AS i FROM tx WHERE line_no = 1) WHERE i = 1)"""


@query("own_transfer_exact", with_ctes(TX, _HOLDERS) + """
SELECT DISTINCT t.job_id, t.mov_id FROM tx t JOIN names n ON t.job_id = n.job_id AND contains(t.description, n.name)""")
def own_transfer_exact(spark, d):
    return O.own_by_name_exact(A.movements(spark, d), O.name_pool(_holders(spark, d)))


@query("own_transfer_fuzzy", with_ctes(TX, _HOLDERS) + """
, w AS (SELECT job_id, mov_id, string_split(description, ' ') AS w FROM tx), runs AS (SELECT DISTINCT job_id, array_to_string(list_slice(w, i, i + 1), ' ') AS run FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i) u),
hit AS (SELECT DISTINCT r.job_id, run FROM runs r JOIN names n ON r.job_id = n.job_id AND abs(len(run) - len(name)) * 100 <= 15 * greatest(len(run), len(name)) WHERE levenshtein(run, name) * 100 <= 15 * greatest(len(run), len(name)))
SELECT DISTINCT w.job_id, w.mov_id FROM w, LATERAL (SELECT unnest(range(1, len(w.w))) AS i) u JOIN hit h ON h.job_id = w.job_id AND h.run = array_to_string(list_slice(w.w, u.i, u.i + 1), ' ')""")
def own_transfer_fuzzy(spark, d):
    return O.own_by_name_fuzzy(A.movements(spark, d), O.name_pool(_holders(spark, d)))


# Runs and names whose edits allow a ratio of 0.85, then their longest common blocks, region by region.
@query("own_transfer_ratio", "WITH RECURSIVE " + with_ctes(TX, _HOLDERS).removeprefix("WITH ") + """
, w AS (SELECT job_id, mov_id, string_split(description, ' ') AS w FROM tx), runs AS (SELECT DISTINCT job_id, array_to_string(list_slice(w, i, i + 1), ' ') AS run FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i) u),
pr AS (SELECT DISTINCT name AS a, run AS b FROM runs r JOIN names n ON r.job_id = n.job_id AND abs(len(run) - len(name)) * 100 <= 15 * (len(run) + len(name)) WHERE levenshtein(run, name) * 100 <= 15 * (len(run) + len(name))),
rg(a, b, a0, a1, b0, b1, m) AS (
 SELECT a, b, 1::BIGINT, len(a) + 1, 1::BIGINT, len(b) + 1, list_max(flatten([[list_max([l FOR l IN range(0, least(len(a) - i, len(b) - j) + 2) IF substr(a, i, l) = substr(b, j, l)]) * 10000 + (99 - i) * 100 + (99 - j) FOR j IN range(1, len(b) + 1)] FOR i IN range(1, len(a) + 1)])) FROM pr
 UNION ALL
 SELECT a, b, r.x0, r.x1, r.y0, r.y1, list_max(flatten([[list_max([l FOR l IN range(0, least(r.x1 - i, r.y1 - j) + 1) IF substr(a, i, l) = substr(b, j, l)]) * 10000 + (99 - i) * 100 + (99 - j) FOR j IN range(r.y0, r.y1)] FOR i IN range(r.x0, r.x1)])) FROM (
  SELECT a, b, unnest([{'x0': a0, 'x1': i, 'y0': b0, 'y1': j}, {'x0': i + n, 'x1': a1, 'y0': j + n, 'y1': b1}]) AS r FROM (
   SELECT *, m // 10000 AS n, 99 - (m // 100) % 100 AS i, 99 - m % 100 AS j FROM rg WHERE m // 10000 > 0)) WHERE r.x1 > r.x0 AND r.y1 > r.y0),
hit AS (SELECT a, b FROM rg GROUP BY a, b HAVING 200 * sum(m // 10000) >= 85 * (len(a) + len(b)))
SELECT DISTINCT w.job_id, w.mov_id FROM w, LATERAL (SELECT unnest(range(1, len(w.w))) AS i) u JOIN hit h ON h.b = array_to_string(list_slice(w.w, u.i, u.i + 1), ' ') JOIN names n ON n.job_id = w.job_id AND n.name = h.a""")
def own_transfer_ratio(spark, d):
    return O.own_by_name_ratio(A.movements(spark, d), O.name_pool(_holders(spark, d)))


@query("identity_pools", with_ctes(TX, _OWN, _HOLDERS) + """
SELECT job_id, 'account' AS kind, account AS value FROM pool UNION ALL SELECT job_id, 'name', name FROM names""")
def identity_pools(spark, d):
    _, cov = _own_frames(spark, d)
    accounts = O.account_pool(cov).select("job_id", F.lit("account").alias("kind"), F.col("account").alias("value"))
    names = O.name_pool(_holders(spark, d)).select("job_id", F.lit("name").alias("kind"), F.col("name").alias("value"))
    return accounts.unionByName(names)


# Totals.
_CATS = ("EFECTIVO", "TRASPASO_ABONO", "TRASPASO_CARGO", "FINANCIAMIENTO", "BMRCASH", "MORATORIOS", "TPV",
         "COMISION_CR", "COMISION_DB", "COMISION_AMEX", "COMISION_TPV_MIXTA", "PAGO_FINANCIAMIENTO")
_CAT_SUMS = ", ".join(f"CAST(sum(CASE WHEN category = '{c}' THEN amount ELSE 0 END) AS DOUBLE) AS {c.lower()}" for c in _CATS)
_KNOWN = ", ".join(f"'{c}'" for c in _CATS)
TOTALS = f"""totals AS (SELECT doc_id, {_CAT_SUMS},
 CAST(sum(CASE WHEN kind = 'abono' THEN amount ELSE 0 END) AS DOUBLE) AS depositos,
 count(*) FILTER (category = 'TPV') AS n_tpv, count(*) FILTER (category IN ({_KNOWN}) AND category <> 'TPV') AS n_otros,
 count(*) FILTER (category NOT IN ({_KNOWN}) AND category <> 'BASURA_OCR') AS n_general, count(*) AS n_movements
 FROM classified GROUP BY doc_id)"""
QUALITY = """sums AS (SELECT doc_id, sum(CASE WHEN kind = 'abono' THEN amount ELSE 0 END) AS credits_read,
 sum(CASE WHEN kind = 'cargo' THEN amount ELSE 0 END) AS charges_read,
 avg(CASE WHEN category <> 'GENERAL' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS categorized_pct FROM classified GROUP BY doc_id),
simil AS (SELECT s.*, c.deposits, c.charges,
 CASE WHEN credits_read = 0 AND deposits = 0 THEN 100.0::DOUBLE WHEN credits_read = 0 OR deposits = 0 THEN 0.0::DOUBLE
 ELSE least(credits_read, deposits)::DOUBLE / greatest(credits_read, deposits)::DOUBLE * 100.0::DOUBLE END AS sim_in,
 CASE WHEN charges_read = 0 AND charges = 0 THEN 100.0::DOUBLE WHEN charges_read = 0 OR charges = 0 THEN 0.0::DOUBLE
 ELSE least(charges_read, charges)::DOUBLE / greatest(charges_read, charges)::DOUBLE * 100.0::DOUBLE END AS sim_out
 FROM sums s JOIN cover c ON s.doc_id = c.doc_id),
quality AS (SELECT *, round((sim_in + sim_out) / 2.0::DOUBLE, 2) AS confidence FROM simil)"""


@query("category_totals", with_ctes(*CLASSIFIED, TOTALS) + "SELECT * FROM totals")
def category_totals(spark, d):
    return T.category_totals(classified(spark, d))


@query("fee_rollup", with_ctes(*CLASSIFIED, COVER, TOTALS) + """
SELECT t.doc_id, round(comision_cr + comision_db + comision_amex + comision_tpv_mixta, 2) AS fees_total,
 round(tpv - CAST(c.fees AS DOUBLE), 2) AS tpv_net FROM totals t JOIN cover c ON t.doc_id = c.doc_id""")
def fee_rollup(spark, d):
    mov = classified(spark, d)
    return T.fee_rollup(T.category_totals(mov), A.covers(mov)).select("doc_id", "fees_total", "tpv_net")


@query("extraction_confidence", with_ctes(*CLASSIFIED, COVER, QUALITY) + "SELECT doc_id, confidence FROM quality")
def extraction_confidence(spark, d):
    mov = classified(spark, d)
    return T.extraction_quality(T.extracted_sums(mov), A.covers(mov)).select("doc_id", "confidence")


@query("declared_gaps", with_ctes(*CLASSIFIED, COVER, QUALITY) + """
SELECT doc_id, CAST(abs(deposits - credits_read) AS DOUBLE) AS gap_deposits, CAST(abs(charges - charges_read) AS DOUBLE) AS gap_charges FROM quality""")
def declared_gaps(spark, d):
    mov = classified(spark, d)
    return T.extraction_quality(T.extracted_sums(mov), A.covers(mov)).select("doc_id", "gap_deposits", "gap_charges")


@query("categorized_rate", with_ctes(*CLASSIFIED, QUALITY.split("simil AS")[0].rstrip().rstrip(",")) + """
SELECT doc_id, round(categorized_pct, 4) AS categorized_pct FROM sums""")
def categorized_rate(spark, d):
    return T.extracted_sums(classified(spark, d)).select("doc_id", F.round("categorized_pct", 4).alias("categorized_pct"))


@query("statement_summary", with_ctes(*CLASSIFIED, COVER, TOTALS, QUALITY) + """
SELECT t.*, round(comision_cr + comision_db + comision_amex + comision_tpv_mixta, 2) AS fees_total,
 round(tpv - CAST(c.fees AS DOUBLE), 2) AS tpv_net, round(categorized_pct, 4) AS categorized_pct, confidence,
 CAST(abs(q.deposits - credits_read) AS DOUBLE) AS gap_deposits, CAST(abs(q.charges - charges_read) AS DOUBLE) AS gap_charges
FROM totals t JOIN cover c ON t.doc_id = c.doc_id JOIN quality q ON t.doc_id = q.doc_id""")
def statement_summary(spark, d):
    from balanza.plans.statement import summarize

    mov = A.movements(spark, d)
    return summarize(mov, A.covers(mov), RULES)


@query("job_totals", with_ctes(TX, COVER) + """
SELECT job_id, CAST(sum(deposits) AS DOUBLE) AS total_deposits, count(*) AS accounts, sum(deposits) >= 250000 AS gate_flag, sum(deposits) > 250000 AS report_flag
FROM cover GROUP BY job_id""")
def job_totals(spark, d):
    return T.job_totals(A.covers(A.movements(spark, d)))


# Covers with texts: each supplier sends two statements, the second a copy for every third one.
_SIGNED = """signed AS (SELECT doc_id, job_id, k AS copy, concat('  ', CASE WHEN k = 1 THEN 'BBVA' ELSE 'bbva ' END) AS bank,
 concat('ABC', lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS rfc, concat('0-', lpad(CAST(doc_id AS VARCHAR), 17, '1')) AS clabe,
 period_start, period_end, CASE WHEN k = 2 AND doc_id % 3 <> 0 THEN deposits + 1 ELSE deposits END AS deposits, charges
 FROM cover, LATERAL (SELECT unnest([1, 2]) AS k) u)"""


def _signed(spark, d):
    cov = A.covers(A.movements(spark, d)).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    doc = F.col("doc_id").cast("string")
    return cov.select(
        "doc_id", "job_id", "copy",
        F.concat(F.lit("  "), F.when(F.col("copy") == 1, "BBVA").otherwise("bbva ")).alias("bank"),
        F.concat(F.lit("ABC"), F.lpad(doc, 9, "0")).alias("rfc"),
        F.concat(F.lit("0-"), F.lpad(doc, 17, "1")).alias("clabe"),
        "period_start", "period_end",
        F.when((F.col("copy") == 2) & (F.col("doc_id") % 3 != 0), F.col("deposits") + 1).otherwise(F.col("deposits")).alias("deposits"),
        "charges",
    )


@query("dedup_statements", with_ctes(TX, COVER, _SIGNED) + """
SELECT doc_id, copy, row_number() OVER (PARTITION BY job_id, lower(trim(bank)), rfc, regexp_replace(clabe, '\\D', '', 'g'),
 period_start, period_end, round(deposits, 2), round(charges, 2) ORDER BY copy, doc_id) > 1 AS duplicate FROM signed""")
def dedup_statements(spark, d):
    return dedup.mark_duplicates(_signed(spark, d), ["copy", "doc_id"]).select("doc_id", "copy", "duplicate")


@query("cover_summary", with_ctes(*CLASSIFIED, COVER, TOTALS) + """
SELECT c.doc_id, c.job_id, concat('BANCO-', right(lpad(CAST(c.doc_id AS VARCHAR), 18, '0'), 4)) AS account,
 period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, CAST(c.deposits AS DOUBLE) AS deposits, CAST(c.charges AS DOUBLE) AS charges,
 CAST(c.fees AS DOUBLE) AS fees, tpv, round(tpv - CAST(c.fees AS DOUBLE), 2) AS tpv_net, financiamiento, efectivo, bmrcash, moratorios, pago_financiamiento
FROM cover c JOIN totals t ON c.doc_id = t.doc_id""")
def cover_summary(spark, d):
    from balanza.operators import reports

    mov = classified(spark, d)
    cov = A.covers(mov).withColumns({"bank": F.lit("BANCO"), "clabe": F.lpad(F.col("doc_id").cast("string"), 18, "0")})
    return reports.cover_summary(T.category_totals(mov), cov)


# Detail sheets: providers by the first words of a card sale; the whole cover sheet; both kept as results of jobs.
_SHEET_SQL = ", ".join(f"CASE WHEN {' OR '.join(f"category = '{c}'" for c in names) or 'true'} THEN '{sheet}' END" for sheet, names in reports.DETAIL_SHEETS)
_DETAIL = f"""detail AS (SELECT unnest(list_filter([{_SHEET_SQL}], lambda x: x IS NOT NULL)) AS sheet, job_id, doc_id, mov_id, CASE doc_id % 3 WHEN 0 THEN 'BANORTE' WHEN 1 THEN 'BBVA' ELSE 'HSBC' END AS bank,
 strftime(posted, '01-%m-%Y') AS period, posted, description, amount, kind, category,
 CASE WHEN category = 'TPV' THEN CASE WHEN contains(description, 'red') THEN 'UNO' WHEN contains(description, 'blue') THEN 'DOS' ELSE 'NO DEFINIDA' END END AS provider
 FROM classified WHERE category <> 'BASURA_OCR' AND kind <> 'importe')"""


def _detail(spark, d):
    mov, doc = classified(spark, d), F.col("doc_id")
    bank = F.when(doc % 3 == 0, "BANORTE").when(doc % 3 == 1, "BBVA").otherwise("HSBC")
    provider = F.when(F.col("description").contains("red"), "UNO").when(F.col("description").contains("blue"), "DOS").otherwise("NO DEFINIDA")
    return reports.detail_sheets(mov.withColumns({"bank": bank, "period": F.date_format("posted", "01-MM-yyyy")}), provider)


@query("detail_sheets", with_ctes(*CLASSIFIED, _DETAIL) + """
SELECT sheet, job_id, doc_id, mov_id, bank, period, posted::VARCHAR AS posted, description, CAST(amount AS DOUBLE) AS amount, kind, category, CASE WHEN sheet = 'transacciones_tpv' THEN provider END AS provider FROM detail""")
def detail_sheets(spark, d):
    return _detail(spark, d)


_PAGED = """paged AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (n = 7) AS failed_pages FROM (SELECT doc_id, order_key, max(line_no) AS n FROM tx GROUP BY ALL) GROUP BY doc_id)"""


def _cover_sheet(spark, d):
    mov, doc = classified(spark, d), F.col("doc_id")
    bank = F.when(doc % 11 == 0, "error_cifrado").when(doc % 11 == 1, "ERROR_LECTURA").when(doc % 11 == 2, "duplicado").otherwise("banorte")
    cov = A.covers(mov).withColumns({
        "bank": bank, "rfc": F.concat(F.lit("RFC"), doc.cast("string")), "holder": F.when(doc % 5 != 0, F.concat(F.lit("H"), doc.cast("string"))), "clabe": F.lpad(doc.cast("string"), 18, "0"),
        "file_name": F.concat(F.lit("file-"), doc.cast("string")), "average_balance": F.when(doc % 4 != 0, doc * 1.5),
    })
    # a page is an order; one with a seventh line could not be read
    pages = mov.groupBy("doc_id", F.col("order_key").alias("page")).agg(F.when(F.max("line_no") == 7, 0.0).otherwise(1.0).alias("score")).withColumn("alert", F.lit("OK"))
    sums = T.statement_sums(mov)
    return reports.cover_sheet(cov, sums, T.extraction_quality(sums, cov), T.page_quality(pages))


@query("cover_sheet", with_ctes(*CLASSIFIED, COVER, TOTALS, QUALITY, _PAGED) + """
, j AS (SELECT c.doc_id, c.job_id, c.doc_id % 11 < 2 AS bad, CASE c.doc_id % 11 WHEN 0 THEN 'ERROR_CIFRADO' WHEN 1 THEN 'ERROR_LECTURA' ELSE 'BANORTE' END AS bank, c.*, t.*, q.*, p.* FROM cover c JOIN totals t ON t.doc_id = c.doc_id JOIN quality q ON q.doc_id = c.doc_id JOIN paged p ON p.doc_id = c.doc_id WHERE c.doc_id % 11 <> 2)
SELECT doc_id, job_id, bank, CASE WHEN bad THEN 'N/A' ELSE concat('RFC', doc_id) END AS rfc, CASE WHEN bad THEN 'N/A' WHEN doc_id % 5 <> 0 THEN concat('H', doc_id) ELSE '' END AS holder,
 CASE WHEN bad THEN concat('file-', doc_id) ELSE lpad(doc_id::VARCHAR, 18, '0') END AS clabe, CASE WHEN bad THEN 'N/A' ELSE period_start::VARCHAR END AS period_start, CASE WHEN bad THEN 'N/A' ELSE period_end::VARCHAR END AS period_end,
 CASE WHEN bank = 'ERROR_CIFRADO' THEN 'CON CONTRASEÑA' WHEN bad THEN 'ERROR DE PROCESAMIENTO' END AS message, """ + ", ".join(
    f"CASE WHEN bad THEN 0 ELSE round(({x})::DOUBLE, 2) END AS {n}" for n, x in (
        ("deposits", "deposits"), ("charges", "charges"), ("deposits_read", "credits_read"), ("charges_read", "charges_read"), ("average_balance", "CASE WHEN doc_id % 4 <> 0 THEN doc_id * 1.5 ELSE 0 END"), ("fees", "fees"),
        ("fees_credit", "comision_cr"), ("fees_debit", "comision_db"), ("fees_amex", "comision_amex"), ("fees_total", "comision_cr + comision_db + comision_amex + comision_tpv_mixta"),
        ("financing_payments", "pago_financiamiento"), ("confidence", "confidence"), ("gap_deposits", "abs(deposits - credits_read)"), ("gap_charges", "abs(charges - charges_read)"), ("categorized_pct", "categorized_pct"),
    )) + """, CASE WHEN bad THEN 0 ELSE pages END AS pages, CASE WHEN bad THEN 0 ELSE failed_pages END AS failed_pages FROM j""")
def cover_sheet(spark, d):
    out = _cover_sheet(spark, d)
    return out.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# All sheets of all jobs written twice, then jobs 2 and 3 again by a run that finds no card sales: what counts, read back.
@query("result_store", with_ctes(*CLASSIFIED, COVER, _DETAIL) + """
, k AS (SELECT job_id, 'detail' AS sheet, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM detail WHERE NOT (job_id IN (2, 3) AND category = 'TPV') GROUP BY ALL
 UNION ALL SELECT job_id, 'covers', count(*), CAST(sum(deposits) AS DOUBLE) FROM cover GROUP BY ALL)
SELECT job_id, sheet, n AS "rows", total, CASE WHEN job_id IN (2, 3) THEN 'second' ELSE 'first' END AS run FROM k""")
def result_store(spark, d):
    path = f"{checkpoint_root(spark)}/results/{uuid.uuid4().hex}"
    detail, covers = cut(_detail(spark, d), "zstd"), cut(A.covers(A.movements(spark, d)))
    jobs = covers.select("job_id").distinct()
    for _ in range(2):
        results.write_run({"detail": detail, "covers": covers}, jobs, path, "first")
    results.write_run({"detail": detail.filter("category <> 'TPV'"), "covers": covers}, jobs.filter("job_id in (2, 3)"), path, "second")
    runs = results.read_manifest(spark, path)
    read = results.read_sheet(spark, path, "detail", detail.schema).select("job_id", F.lit("detail").alias("sheet"), "amount")
    read = read.unionByName(results.read_sheet(spark, path, "covers", covers.schema).select("job_id", F.lit("covers").alias("sheet"), F.col("deposits").alias("amount")))
    sums = read.groupBy("job_id", "sheet").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("total"))
    return sums.join(runs.select("job_id", "sheet", "run"), ["job_id", "sheet"])


@query("account_summary", with_ctes(*CLASSIFIED, COVER, TOTALS) + """
SELECT CASE WHEN c.doc_id % 7 = 0 THEN 'N/A' ELSE period_end::VARCHAR END AS month,
 CASE WHEN c.doc_id % 7 = 0 THEN concat('file-', c.doc_id) ELSE concat('BANCO-', right(lpad(CAST(c.doc_id AS VARCHAR), 18, '0'), 4)) END AS account,
 CASE WHEN c.doc_id % 7 = 0 THEN 'N/A' ELSE 'MXN' END AS currency,
 CASE WHEN c.doc_id % 14 = 0 THEN 'CON CONTRASEÑA' WHEN c.doc_id % 7 = 0 THEN 'ERROR DE PROCESAMIENTO' END AS error,
 CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE CAST(c.deposits AS DOUBLE) END AS deposits, CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE CAST(c.charges AS DOUBLE) END AS charges,
 CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE tpv END AS tpv, CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE financiamiento END AS financing,
 CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE efectivo END AS cash, CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE traspaso_abono END AS transfers_in,
 CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE traspaso_cargo END AS transfers_out, CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE bmrcash END AS marketplace,
 CASE WHEN c.doc_id % 7 = 0 THEN 0 ELSE moratorios END AS late_fees
FROM cover c JOIN totals t ON c.doc_id = t.doc_id WHERE c.doc_id % 11 <> 0""")
def account_summary(spark, d):
    from balanza.operators import reports

    mov = classified(spark, d)
    doc = F.col("doc_id")
    bank = (
        F.when(doc % 11 == 0, "DUPLICADO").when(doc % 14 == 0, "ERROR_CIFRADO").when(doc % 7 == 0, "ERROR_LECTURA").otherwise("BANCO")
    )
    cov = A.covers(mov).withColumns({
        "bank": bank, "clabe": F.lpad(doc.cast("string"), 18, "0"), "file_name": F.concat(F.lit("file-"), doc.cast("string")),
    })
    return reports.account_summary(T.category_totals(mov), cov)


@query("classification_audit", with_ctes(*CLASSIFIED) + """
SELECT doc_id, mov_id, posted::VARCHAR AS posted, description, CAST(amount AS DOUBLE) AS amount, kind, category, reason FROM classified""")
def classification_audit(spark, d):
    return classified(spark, d).select("doc_id", "mov_id", "posted", "description", "amount", "kind", "category", "reason")


@query("union_results", with_ctes(TX) + """
SELECT mov_id, 'digital' AS source, kind, NULL::VARCHAR AS error FROM tx WHERE line_no % 3 = 0
UNION ALL SELECT mov_id, 'ocr', kind, NULL FROM tx WHERE line_no % 3 = 1
UNION ALL SELECT mov_id, 'failed', NULL, 'ERROR_LECTURA' FROM tx WHERE line_no % 3 = 2""")
def union_results(spark, d):
    from balanza.operators.intake import union_results as union

    mov = A.movements(spark, d)
    digital = mov.filter("line_no % 3 = 0").select("mov_id", F.lit("digital").alias("source"), "kind")
    ocr = mov.filter("line_no % 3 = 1").select("mov_id", F.lit("ocr").alias("source"), "kind")
    failed = mov.filter("line_no % 3 = 2").select("mov_id", F.lit("failed").alias("source"), F.lit("ERROR_LECTURA").alias("error"))
    return union(digital, ocr, failed).select("mov_id", "source", "kind", "error")


# Running balance: the balance read on a statement is missing on some rows and wrong on others.
_BALANCE = """read AS (SELECT *, CASE WHEN line_no = 5 THEN NULL WHEN line_no = 6 THEN true_balance + 10 ELSE true_balance END AS balance FROM (
 SELECT doc_id, mov_id, posted, kind, amount, line_no, 1000 + sum(CASE kind WHEN 'abono' THEN amount WHEN 'cargo' THEN -amount ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY posted, mov_id ROWS UNBOUNDED PRECEDING) AS true_balance FROM tx))"""


@query("running_balance", with_ctes(TX, _BALANCE) + """
SELECT doc_id, mov_id, CAST(true_balance AS DOUBLE) AS expected, balance IS NULL OR abs(balance - true_balance) > 0.01 AS review,
 CASE WHEN balance IS NULL OR abs(balance - true_balance) > 0.01 THEN CAST(true_balance AS DOUBLE) END AS inferred FROM read""")
def running_balance(spark, d):
    mov = A.movements(spark, d)
    signed = F.when(F.col("kind") == "abono", F.col("amount")).when(F.col("kind") == "cargo", -F.col("amount")).otherwise(0)
    block = F.trunc("posted", "month")
    true = ordered.running_sum(mov, ["doc_id"], ["posted", "mov_id"], {"_true": signed}, block)
    read = true.withColumn(
        "balance",
        F.when(F.col("line_no") == 6, F.col("_true") + 1010).when(F.col("line_no") != 5, F.col("_true") + 1000),
    ).drop("_true")
    out = reconcile.running_balance(read, F.lit(1000).cast("decimal(18,2)"), ["posted", "mov_id"], block)
    return out.select("doc_id", "mov_id", "expected", "review", "inferred")


# The same where a read balance one cent off is carried on: cents creep along the statement.
@query("running_balance_strict", "WITH RECURSIVE " + with_ctes(TX).removeprefix("WITH ") + """
, seen AS (SELECT doc_id, mov_id, line_no, order_key, CASE kind WHEN 'abono' THEN amount WHEN 'cargo' THEN -amount ELSE 0 END AS signed,
  row_number() OVER (PARTITION BY doc_id ORDER BY posted, mov_id) AS rn, sum(CASE kind WHEN 'abono' THEN amount WHEN 'cargo' THEN -amount ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY posted, mov_id ROWS UNBOUNDED PRECEDING) AS moved FROM tx),
seq AS (SELECT doc_id, mov_id, rn, signed, CASE WHEN line_no = 6 THEN moved + 1010 WHEN line_no <> 5 THEN moved + 1000 + CAST((order_key % 5 - 1) * 0.01 AS DECIMAL(18,2)) END AS balance FROM seen),
walk(doc_id, rn, mov_id, expected, balance, carried) AS (
 SELECT doc_id, rn, mov_id, CAST(1000 + signed AS DECIMAL(20,2)), balance, CAST(CASE WHEN abs(balance - (1000 + signed)) <= 0.01 THEN balance ELSE 1000 + signed END AS DECIMAL(20,2)) FROM seq WHERE rn = 1
 UNION ALL
 SELECT s.doc_id, s.rn, s.mov_id, CAST(w.carried + s.signed AS DECIMAL(20,2)), s.balance, CAST(CASE WHEN abs(s.balance - (w.carried + s.signed)) <= 0.01 THEN s.balance ELSE w.carried + s.signed END AS DECIMAL(20,2))
 FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.rn = w.rn + 1)
SELECT doc_id, mov_id, CAST(expected AS DOUBLE) AS expected, balance IS NULL OR abs(balance - expected) > 0.01 AS review,
 CASE WHEN balance IS NULL OR abs(balance - expected) > 0.01 THEN CAST(expected AS DOUBLE) END AS inferred, CAST(carried AS DOUBLE) AS carried FROM walk""")
def running_balance_strict(spark, d):
    mov = A.movements(spark, d)
    signed = F.when(F.col("kind") == "abono", F.col("amount")).when(F.col("kind") == "cargo", -F.col("amount")).otherwise(0)
    mov = mov.select("doc_id", "mov_id", "posted", "kind", "amount", "line_no", "order_key", F.trunc("posted", "month").alias("month"))
    true = ordered.running_sum(mov, ["doc_id"], ["posted", "mov_id"], {"_true": signed}, "month")
    creep = ((F.col("order_key") % 5 - 1) * F.lit(0.01).cast("decimal(4,2)")).cast("decimal(18,2)")
    read = true.withColumn(
        "balance",
        F.when(F.col("line_no") == 6, F.col("_true") + 1010).when(F.col("line_no") != 5, F.col("_true") + 1000 + creep),
    ).drop("_true", "line_no", "order_key")
    out = reconcile.running_balance_strict(read, F.lit(1000).cast("decimal(18,2)"), ["posted", "mov_id"], "month")
    return out.select("doc_id", "mov_id", F.col("expected").cast("double").alias("expected"), "review", F.col("inferred").cast("double").alias("inferred"), F.col("carried").cast("double").alias("carried"))


# Reconciliation of three sources per cover.
@query("reconcile_sources", with_ctes(TX, COVER) + """
, src AS (SELECT doc_id, deposits AS rx, CASE WHEN doc_id % 4 = 0 THEN deposits + 5 ELSE deposits END AS a,
 CASE WHEN doc_id % 4 IN (0, 1) THEN deposits + 7 WHEN doc_id % 4 = 2 THEN NULL ELSE deposits END AS b, charges FROM cover)
SELECT doc_id, CAST(CASE WHEN a = b THEN a WHEN a = rx THEN a WHEN b = rx THEN b ELSE coalesce(b, a) END AS DOUBLE) AS deposits,
 CASE WHEN doc_id % 2 = 0 THEN concat('RX', lpad(CAST(doc_id AS VARCHAR), 11, '0')) WHEN doc_id % 3 = 0 THEN 'ABC010101AB' ELSE 'ABC010101ABC' END AS rfc,
 CASE WHEN doc_id % 5 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 18, '0') ELSE '123' END AS clabe,
 CASE WHEN doc_id % 3 = 0 THEN concat('GPT ', doc_id) ELSE concat('OCR ', doc_id) END AS holder
FROM src""")
def reconcile_sources(spark, d):
    cov = A.covers(A.movements(spark, d))
    doc, dep = F.col("doc_id"), F.col("deposits").cast("double")
    text = doc.cast("string")
    a = F.struct(
        F.when(doc % 4 == 0, dep + 5).otherwise(dep).alias("deposits"),
        F.when(doc % 3 == 0, F.lit("ABC010101AB")).otherwise(F.lit("ABC010101ABC")).alias("rfc"),
        F.lit("123").alias("clabe"),
        F.when(doc % 3 == 0, F.lit("None")).otherwise(F.concat(F.lit("OCR "), text)).alias("holder"),
    )
    b = F.struct(
        F.when((doc % 4).isin(0, 1), dep + 7).when(doc % 4 != 2, dep).alias("deposits"),
        F.lit("ABC").alias("rfc"),
        F.when(doc % 5 == 0, F.lpad(text, 18, "0")).otherwise(F.lit("12")).alias("clabe"),
        F.concat(F.lit("GPT "), text).alias("holder"),
    )
    rx = F.struct(
        dep.alias("deposits"),
        F.when(doc % 2 == 0, F.concat(F.lit("rx"), F.lpad(text, 11, "0"))).alias("rfc"),
        F.lit(None).cast("string").alias("clabe"),
        F.lit(None).cast("string").alias("holder"),
    )
    frame = cov.select("doc_id", a.alias("a"), b.alias("b"), rx.alias("rx"))
    return reconcile.reconcile_sources(frame, numeric=["deposits"], exact=["rfc", "clabe"], text=["holder"]).select(
        "doc_id", "deposits", "rfc", "clabe", "holder"
    )


@query("inherit_identity", with_ctes(TX, COVER) + """
, given AS (SELECT doc_id, job_id, concat('R', CAST(floor(doc_id / 30) AS INT)) AS rfc, CASE WHEN doc_id % 3 = 0 THEN concat('N', doc_id) ELSE '' END AS holder FROM cover),
memo AS (SELECT *, max(CASE WHEN holder <> '' THEN doc_id END) OVER (PARTITION BY job_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS at FROM given)
SELECT m.doc_id, CASE WHEN m.holder = '' AND g.rfc = m.rfc THEN g.holder ELSE m.holder END AS holder
FROM memo m LEFT JOIN given g ON g.doc_id = m.at""")
def inherit_identity(spark, d):
    cov = A.covers(A.movements(spark, d))
    doc = F.col("doc_id")
    given = cov.select(
        "doc_id", "job_id", F.concat(F.lit("R"), F.floor(doc / 30).cast("string")).alias("rfc"),
        F.when(doc % 3 == 0, F.concat(F.lit("N"), doc.cast("string"))).otherwise(F.lit("")).alias("holder"),
    )
    return reconcile.inherit_identity(given, "job_id", ["doc_id"], F.floor(doc / 64)).select("doc_id", "holder")


# Fragment rows against their parent rows: by day and amount.
_FRAG = """base AS (SELECT doc_id, mov_id, date_trunc('month', posted) AS posted, round(amount / 1000) AS amount,
 list_filter(string_split(description, ' '), lambda x: len(x) > 2) AS kw,
 CASE WHEN line_no = 1 THEN 'parent' WHEN line_no IN (2, 3) THEN 'child' ELSE 'other' END AS role FROM tx),
near AS (SELECT c.doc_id, c.mov_id AS child, p.mov_id AS parent, p.posted = c.posted AS same_day,
 len(list_intersect(p.kw, c.kw)) > 0 AS shared, count(*) FILTER (p.posted = c.posted) OVER (PARTITION BY c.mov_id) AS n
 FROM base c JOIN base p ON c.role = 'child' AND p.role = 'parent' AND c.doc_id = p.doc_id AND c.amount = p.amount),
pick AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY parent) AS rn FROM near
 WHERE (n = 1 AND same_day) OR (n > 1 AND same_day AND shared) OR (n = 0 AND shared))"""


@query("merge_duplicates", with_ctes(TX, _FRAG) + "SELECT doc_id, child, parent, n = 1 AS only_candidate FROM pick WHERE rn = 1")
def merge_duplicates(spark, d):
    mov = A.movements(spark, d)
    line = F.col("line_no")
    rows = mov.select(
        "doc_id", "mov_id", F.trunc("posted", "month").alias("posted"),
        F.round(F.col("amount") / 1000).cast("decimal(18,2)").alias("amount"), "description",
        F.when(line == 1, "parent").when(line.isin(2, 3), "child").otherwise("other").alias("role"),
    )
    return dedup.match_fragments(rows).select("doc_id", "child", "parent", "only_candidate")


_NTO1 = """frag AS (SELECT doc_id, order_key, posted, lpad(CAST(order_key AS VARCHAR), 8, '0') AS ref, amount, mov_id FROM tx WHERE line_no > 2),
grp AS (SELECT doc_id, date_trunc('year', posted) AS y, ref, sum(amount) AS total, count(*) AS n FROM frag GROUP BY ALL),
par AS (SELECT doc_id, date_trunc('year', posted) AS y, mov_id, amount FROM tx WHERE line_no <= 2),
hit AS (SELECT g.doc_id, g.ref, g.y, g.n, p.mov_id, count(*) OVER (PARTITION BY g.doc_id, g.y, g.ref) AS c FROM grp g JOIN par p ON g.doc_id = p.doc_id AND g.y = p.y AND round(g.total / 2000) = round(p.amount / 2000))"""


@query("merge_fragments", with_ctes(TX, _NTO1) + """
SELECT h.doc_id, h.mov_id AS parent, h.ref, f.mov_id AS child, h.n AS fragments FROM hit h JOIN frag f ON h.doc_id = f.doc_id AND h.ref = f.ref AND date_trunc('year', f.posted) = h.y WHERE c = 1 AND h.n > 1""")
def merge_fragments(spark, d):
    mov = A.movements(spark, d)
    frag = mov.filter("line_no > 2").select(
        "doc_id", "mov_id", F.trunc("posted", "year").alias("posted"), "amount",
        F.concat(F.lit("ref "), F.lpad(F.col("order_key").cast("string"), 8, "0")).alias("description"),
    )
    parent = mov.filter("line_no <= 2").select("doc_id", "mov_id", F.trunc("posted", "year").alias("posted"), "amount")
    return dedup.match_fragment_sums(frag, parent, unit=2000).select("doc_id", "parent", "ref", "child", "fragments")


_APPLY = """base AS (SELECT doc_id, mov_id, date_trunc('month', posted) AS posted, round(amount / 1000) AS amount, line_no >= 4 AS fragment,
 CASE WHEN line_no >= 4 THEN concat('ref ', lpad(CAST(order_key AS VARCHAR), 8, '0')) ELSE description END AS description,
 CASE WHEN line_no = 1 THEN 'parent' ELSE 'child' END AS role FROM tx),
grp AS (SELECT doc_id, posted, description AS ref, sum(amount) AS total FROM base WHERE fragment GROUP BY ALL HAVING count(*) > 1),
par AS (SELECT doc_id, posted, amount, min(mov_id) AS parent FROM base WHERE role = 'parent' GROUP BY ALL HAVING count(*) = 1),
summed AS (SELECT b.doc_id, b.mov_id AS child, p.parent, g.ref FROM grp g JOIN par p ON g.doc_id = p.doc_id AND g.posted = p.posted AND g.total = p.amount JOIN base b ON b.fragment AND b.doc_id = g.doc_id AND b.posted = g.posted AND b.description = g.ref),
kw AS (SELECT *, list_filter(string_split(description, ' '), lambda x: len(x) > 2) AS kw FROM base),
rest AS (SELECT * FROM kw WHERE mov_id NOT IN (SELECT child FROM summed)),
near AS (SELECT c.doc_id, c.mov_id AS child, p.mov_id AS parent, p.posted = c.posted AS same_day, len(list_intersect(p.kw, c.kw)) > 0 AS shared, count(*) FILTER (p.posted = c.posted) OVER (PARTITION BY c.mov_id) AS n
 FROM rest c JOIN rest p ON c.role = 'child' AND p.role = 'parent' AND c.doc_id = p.doc_id AND c.amount = p.amount),
single AS (SELECT doc_id, child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY parent) AS rn FROM near WHERE (n = 1 AND same_day) OR (n > 1 AND same_day AND shared) OR (n = 0 AND shared)) WHERE rn = 1),
t1 AS (SELECT doc_id, parent, string_agg(t, '' ORDER BY ref) AS t FROM (SELECT s.doc_id, s.parent, s.ref, concat(' | DESGLOSE: ', string_agg(b.description, ' | ' ORDER BY s.child)) AS t FROM summed s JOIN base b ON b.mov_id = s.child GROUP BY ALL) GROUP BY ALL),
t2 AS (SELECT s.doc_id, s.parent, concat(' | ', string_agg(b.description, ' | ' ORDER BY s.child)) AS t FROM single s JOIN base b ON b.mov_id = s.child GROUP BY ALL)"""


@query("merge_apply", with_ctes(TX, _APPLY) + """
SELECT b.doc_id, b.mov_id, b.role, concat(b.description, coalesce(t1.t, ''), coalesce(t2.t, '')) AS description FROM base b LEFT JOIN t1 ON t1.doc_id = b.doc_id AND t1.parent = b.mov_id LEFT JOIN t2 ON t2.doc_id = b.doc_id AND t2.parent = b.mov_id
WHERE b.mov_id NOT IN (SELECT child FROM summed) AND b.mov_id NOT IN (SELECT child FROM single)""")
def merge_apply(spark, d):
    line = F.col("line_no")
    rows = A.movements(spark, d).select(
        "doc_id", "mov_id", F.trunc("posted", "month").alias("posted"), F.round(F.col("amount") / 1000).cast("decimal(18,2)").alias("amount"), (line >= 4).alias("fragment"),
        F.when(line >= 4, F.concat(F.lit("ref "), F.lpad(F.col("order_key").cast("string"), 8, "0"))).otherwise(F.col("description")).alias("description"),
        F.when(line == 1, "parent").otherwise("child").alias("role"),
    )
    return dedup.apply_fragments(rows).select("doc_id", "mov_id", "role", "description")


_TRANSFERS = """base AS (SELECT doc_id, mov_id, strftime(posted, '%d') AS day, round(amount / 1000) AS amount, list_filter(string_split(description, ' '), lambda x: len(x) > 2) AS kw,
 CASE WHEN line_no = 1 AND order_key % 2 = 0 THEN 'parent' WHEN line_no IN (2, 3) THEN 'child' ELSE 'other' END AS role FROM tx),
near AS (SELECT c.doc_id, c.mov_id AS child, p.mov_id AS parent, len(list_intersect(p.kw, c.kw)) > 0 AS shared, count(*) OVER (PARTITION BY c.mov_id) AS n
 FROM base c JOIN base p ON c.role = 'child' AND p.role = 'parent' AND c.doc_id = p.doc_id AND c.amount = p.amount AND c.day = p.day)"""


@query("transfer_details", with_ctes(TX, _TRANSFERS) + """
SELECT doc_id, child, min(parent) AS parent, n = 1 AS only_candidate FROM near WHERE n = 1 OR shared GROUP BY doc_id, child, n""")
def transfer_details(spark, d):
    line = F.col("line_no")
    section = F.when(line == 2, "SPEI_RECIBIDOS").when(line == 3, "SPEI_ENVIADOS").otherwise("PRINCIPAL")
    rows = A.movements(spark, d).select(
        "doc_id", "mov_id", F.date_format("posted", "dd MMM").alias("date_text"), F.round(F.col("amount") / 1000).cast("decimal(18,2)").alias("amount"),
        F.when((line == 1) & (F.col("order_key") % 2 == 0), F.concat(F.lit("SPEI "), "description")).otherwise(F.col("description")).alias("description"), section.alias("section"),
    )
    return dedup.match_transfer_details(rows).select("doc_id", "child", "parent", "only_candidate")


@query("kapital_sums", with_ctes(TX, COVER) + """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id * 3 + 1.5 ELSE deposits END::DOUBLE AS deposits, CASE WHEN doc_id % 3 = 0 THEN doc_id * 8 + 0.25 ELSE charges END::DOUBLE AS charges FROM cover""")
def kapital_sums(spark, d):
    doc, none = F.col("doc_id").cast("double"), F.lit(None).cast("double")
    parts = {name: none for name in (*reconcile.KAPITAL_DEPOSITS, *reconcile.KAPITAL_CHARGES)}
    parts |= {"dep_efectivo": doc, "transf_recibidas": doc * 2, "movimientos_mes_abonos": F.lit(1.5), "ret_isr": doc * 7, "amort_prestamos": doc, "movimientos_mes_cargos": F.lit(0.25)}
    cov = A.covers(A.movements(spark, d)).select("doc_id", F.col("deposits").cast("double").alias("deposits"), F.col("charges").cast("double").alias("charges"),
                                                 F.when(F.col("doc_id") % 3 == 0, "Kapital").otherwise("bbva").alias("bank"))
    return reconcile.kapital_sums(cov.withColumns(parts)).select("doc_id", "deposits", "charges")


@query("valid_account", with_ctes(TX, COVER) + """
, acc AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bba830831lj2' WHEN 1 THEN 'ABC010101AB1' WHEN 2 THEN 'ABC01' ELSE 'XYZ020202XY2' END AS rfc,
 CASE doc_id % 3 WHEN 0 THEN lpad(CAST(doc_id AS VARCHAR), 18, '0') WHEN 1 THEN lpad(CAST(doc_id AS VARCHAR), 15, '0') ELSE '' END AS clabe,
 CASE doc_id % 5 WHEN 0 THEN 'American Express' ELSE 'bbva' END AS bank, CASE doc_id % 6 WHEN 5 THEN 'Estado de cuenta de INVERSIONES' ELSE 'x' END AS text FROM cover)
SELECT doc_id, CASE WHEN upper(rfc) = 'BBA830831LJ2' THEN false WHEN length(clabe) >= 18 OR (bank = 'American Express' AND length(clabe) = 15) THEN true
 WHEN text <> 'x' THEN false ELSE regexp_matches(rfc, '^[A-ZÑ&]{3,4}\\d{6}[A-Z0-9]{3}$') END AS valid FROM acc""")
def valid_account(spark, d):
    cov = A.covers(A.movements(spark, d))
    doc, text = F.col("doc_id"), F.col("doc_id").cast("string")
    rfc = F.when(doc % 4 == 0, "bba830831lj2").when(doc % 4 == 1, "ABC010101AB1").when(doc % 4 == 2, "ABC01").otherwise("XYZ020202XY2")
    clabe = F.when(doc % 3 == 0, F.lpad(text, 18, "0")).when(doc % 3 == 1, F.lpad(text, 15, "0")).otherwise("")
    bank = F.when(doc % 5 == 0, "American Express").otherwise("bbva")
    head = F.when(doc % 6 == 5, "Estado de cuenta de INVERSIONES").otherwise("x")
    return cov.select("doc_id", ids.is_valid_account(rfc, clabe, bank, head).alias("valid"))


# Light covers for screening: one month per document, jobs are ten apart.
_LIGHT = """light AS (SELECT doc_id, job_id, CASE WHEN (job_id = 3 AND doc_id // 10 % 5 < 3) OR (job_id = 4 AND doc_id // 10 % 5 = 0) OR (job_id = 5 AND doc_id // 10 % 5 IN (1, 3)) THEN NULL
  ELSE strftime(CAST(DATE '2001-08-01' - to_months(CAST((doc_id // 10) % 5 + 1 AS INT)) AS DATE), '%m-%Y') END AS period,
 CASE WHEN job_id % 2 = 0 THEN concat('R', doc_id % 20) ELSE 'R1' END AS rfc, CASE WHEN job_id % 3 = 0 THEN concat('N', doc_id // 50) ELSE 'N1' END AS holder FROM cover)"""


def _light(spark, d):
    """Every cover; on some the month could not be read."""
    cov = A.covers(A.movements(spark, d))
    doc, job = F.col("doc_id"), F.col("job_id")
    step = (F.floor(doc / 10) % 5).cast("int")
    unread = ((job == 3) & (step < 3)) | ((job == 4) & (step == 0)) | ((job == 5) & step.isin(1, 3))
    return cov.select(
        "doc_id", "job_id", F.when(~unread, F.date_format(F.add_months(F.lit("2001-08-01").cast("date"), -(step + 1)), "MM-yyyy")).alias("period"),
        F.when(job % 2 == 0, F.concat(F.lit("R"), (doc % 20).cast("string"))).otherwise("R1").alias("rfc"),
        F.when(job % 3 == 0, F.concat(F.lit("N"), F.floor(doc / 50).cast("string"))).otherwise("N1").alias("holder"),
    )


@query("period_coverage", with_ctes(TX, COVER, _LIGHT) + """
, got AS (SELECT job_id, list(DISTINCT period) AS p FROM light GROUP BY job_id),
need AS (SELECT *, list_filter(['05-2001', '06-2001', '07-2001'], lambda x: NOT list_contains(p, x)) AS a,
 list_filter(['04-2001', '05-2001', '06-2001'], lambda x: NOT list_contains(p, x)) AS b FROM got),
best AS (SELECT job_id, len(a) = 0 OR len(b) = 0 AS complete, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS m FROM need)
SELECT job_id, complete, CASE WHEN complete THEN 'Se encontraron los 3 meses requeridos.' ELSE
 concat('Faltan al menos ', len(m), ' estado(s) de cuenta de los meses: ', array_to_string(list_transform(m, lambda x: concat(
 CASE left(x, 2) WHEN '04' THEN 'abril' WHEN '05' THEN 'mayo' WHEN '06' THEN 'junio' WHEN '07' THEN 'julio' END, ' 2001')), ', ')) END AS message FROM best""")
def period_coverage(spark, d):
    from balanza.queries.registry import AS_OF

    return screening.period_coverage(_light(spark, d), AS_OF).select("job_id", "complete", "message")


@query("identity_congruence", with_ctes(TX, COVER, _LIGHT) + """
, n AS (SELECT job_id, count(DISTINCT rfc) AS rfcs, count(DISTINCT holder) AS holders FROM light GROUP BY job_id),
v AS (SELECT DISTINCT job_id, 'RFC' AS kind, rfc AS value FROM light UNION SELECT DISTINCT job_id, 'Nombre', holder FROM light)
SELECT v.job_id, v.kind, v.value, rfcs, holders, concat('Se detectaron estados de cuenta que podrían pertenecer a distintos titulares. [',
 CASE WHEN rfcs > 1 AND holders > 1 THEN 'Múltiples RFCs y Múltiples Nombres' WHEN rfcs > 1 THEN 'Múltiples RFCs' ELSE 'Múltiples Nombres' END, ']') AS alert
FROM v JOIN n ON v.job_id = n.job_id WHERE (v.kind = 'RFC' AND rfcs > 1) OR (v.kind = 'Nombre' AND holders > 1)""")
def identity_congruence(spark, d):
    return screening.identity_congruence(_light(spark, d)).select("job_id", "kind", "value", "rfcs", "holders", "alert")
