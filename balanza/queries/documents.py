"""Document text: hashing, admission, cache split, fields, screening scores, line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.functions import ids, money, parse, text as X
from balanza.operators import bank_lines, intake, screening
from balanza.queries.registry import LINES, PAGES, query, with_ctes
from balanza.rules.bank_lines import LineRules
from balanza.sources import adapters as A

FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


def docs(spark, d):
    return A.table(spark, d, "documents")


@query("doc_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def doc_hash(spark, d):
    return docs(spark, d).select("doc_id", intake.content_hash(F.col("text")).alias("hash"))


def _heads():
    return F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-")).when(F.col("doc_id") % 3 == 1, F.lit("PK\x03\x04")).otherwise(F.lit(""))


@query("admit_documents", """
WITH c AS (SELECT doc_id, strlen(text) + CASE doc_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 0 END AS n FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' END AS file_type,
 CASE WHEN doc_id % 3 = 2 THEN 'Tipo de archivo no soportado o falsificado.' WHEN n > 3000 THEN 'El archivo supera el límite permitido.' END AS intake_error FROM c""")
def admit_documents(spark, d):
    files = docs(spark, d).select("doc_id", F.concat(_heads(), F.col("text")).cast("binary").alias("content"))
    return intake.admit(files, max_bytes=3000).select("doc_id", "file_type", "intake_error")


@query("archive_audit", with_ctes(LINES, PAGES) + """
, m AS (SELECT doc_id AS archive, concat(CASE WHEN line = 7 AND doc_id % 5 = 0 THEN '../' ELSE '' END, CASE WHEN line % 6 = 5 THEN '__MACOSX/' ELSE 'a/' END, 'p', line, CASE WHEN line % 4 = 3 THEN '.PDF' ELSE '.pdf' END) AS member,
 length(text) * 1000 AS size, CASE WHEN doc_id % 11 = 0 AND line = 0 THEN 5 ELSE length(text) * 100 END AS packed FROM doc_pages),
s AS (SELECT archive, count(*) AS files, sum(size)::BIGINT AS expanded, max(CASE WHEN packed > 0 THEN size / packed END) AS r,
 bool_or(starts_with(member, '/') OR starts_with(member, '../')) AS escapes FROM m WHERE lower(member) LIKE '%.pdf' AND member NOT LIKE '__MACOSX%' ESCAPE '!' AND NOT starts_with(member, '__MACOSX') GROUP BY archive)
SELECT archive, files, expanded, CASE WHEN r > 100 THEN 'ratio' WHEN files > 10 THEN 'files' WHEN expanded > 2000000 THEN 'size' WHEN escapes THEN 'path' ELSE 'ok' END AS verdict FROM s""")
def archive_audit(spark, d):
    doc, line, size = F.col("doc_id"), F.col("line"), F.length("text")
    member = F.concat(
        F.when((line == 7) & (doc % 5 == 0), "../").otherwise(""), F.when(line % 6 == 5, "__MACOSX/").otherwise("a/"),
        F.lit("p"), line.cast("string"), F.when(line % 4 == 3, ".PDF").otherwise(".pdf"),
    )
    manifest = A.doc_pages(spark, d).select(
        doc.alias("archive"), member.alias("member"), (size * 1000).cast("bigint").alias("size"),
        F.when((doc % 11 == 0) & (line == 0), 5).otherwise(size * 100).alias("packed"),
    )
    return intake.audit_archives(manifest, max_files=10, max_bytes=2_000_000).select("archive", "files", "expanded", "verdict")


_FILES = """files AS (SELECT doc_id % 7 AS job_id, sha256(text) AS hash, concat('new-', doc_id) AS file_name, doc_id FROM documents),
prior AS (SELECT DISTINCT job_id, hash, 'done' AS status FROM files WHERE doc_id % 4 = 0)"""


def _cache_frames(spark, d):
    files = docs(spark, d).select(
        (F.col("doc_id") % 7).alias("job_id"), intake.content_hash(F.col("text")).alias("hash"),
        F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("file_name"), "doc_id",
    )
    prior = files.filter("doc_id % 4 = 0").select("job_id", "hash", F.lit("old").alias("file_name"), F.lit("done").alias("status"))
    return files.drop("doc_id"), prior


@query("cached_docs", with_ctes(_FILES) + "SELECT f.job_id, f.hash, f.file_name, p.status FROM files f JOIN prior p ON f.job_id = p.job_id AND f.hash = p.hash")
def cached_docs(spark, d):
    return intake.split_cached(*_cache_frames(spark, d))[0].select("job_id", "hash", "file_name", "status")


@query("new_docs", with_ctes(_FILES) + "SELECT f.job_id, f.hash, f.file_name FROM files f WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE f.job_id = p.job_id AND f.hash = p.hash)")
def new_docs(spark, d):
    return intake.split_cached(*_cache_frames(spark, d))[1].select("job_id", "hash", "file_name")


@query("amount_in_text", with_ctes(LINES) + """
, t AS (SELECT doc_id, line, concat(text, CASE WHEN line % 3 = 0 THEN concat(' -$ ', doc_id % 900 + 1, ',', lpad((line * 37 % 1000)::VARCHAR, 3, '0'), '.50') ELSE '' END) AS text FROM doc_lines)
SELECT doc_id, line, coalesce(try_cast(regexp_replace(regexp_extract(text, '[+-]?\\$?\\s*\\d{1,3}(?:,\\d{3})*\\.\\d{2}'), '[$,\\s]', '', 'g') AS DOUBLE), 0) AS amount FROM t""")
def amount_in_text(spark, d):
    line = F.col("line")
    tail = F.concat(
        F.lit(" -$ "), (F.col("doc_id") % 900 + 1).cast("string"), F.lit(","),
        F.lpad((line * 37 % 1000).cast("string"), 3, "0"), F.lit(".50"),
    )
    body = F.concat("text", F.when(line % 3 == 0, tail).otherwise(""))
    return A.doc_lines(spark, d).select("doc_id", "line", money.first_money(body).alias("amount"))


@query("fold_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def fold_text(spark, d):
    return docs(spark, d).select("doc_id", X.fold_text(F.col("text")).alias("folded"))


@query("squeeze_blanks", "SELECT doc_id, trim(regexp_replace(replace(text, ' ', '  '), '[ \\t]{2,}', ' ', 'g')) AS squeezed FROM documents")
def squeeze_blanks(spark, d):
    return docs(spark, d).select("doc_id", X.squeeze_blanks(F.replace(F.col("text"), F.lit(" "), F.lit("  "))).alias("squeezed"))


@query("mask_pii", "SELECT doc_id, regexp_replace(text, '\\d{4,}', '****', 'g') AS masked FROM documents")
def mask_pii(spark, d):
    return docs(spark, d).select("doc_id", X.mask_digits(F.col("text")).alias("masked"))


_KYC = """kyc AS (SELECT doc_id, concat(lower(text), ' rfc: ', CASE doc_id % 3 WHEN 0 THEN 'bba830831lj2' ELSE concat('abc', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'xy1') END,
 ' r.f.c.  xyz010203aa', doc_id % 10, ' curp: abcd', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'hdfxyz01') AS text FROM documents)"""


@query("extract_ids", with_ctes(_KYC) + """
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, 'r\\.?f\\.?c\\.?:?\\s+([a-zñ&]{3,4}\\d{6}[a-z0-9]{3})', 1), lambda x: upper(x)),
 lambda x: x NOT IN ('BBA830831LJ2','BNM840515VB1','BSM970519DU8','HMI950125KG8','BMN930209927','SIN9412025I4','CBA131211E64')), ',') AS rfcs,
 array_to_string(list_transform(regexp_extract_all(text, 'curp:\\s*([a-z]{4}\\d{6}[hm][a-z]{5}\\d{2})', 1), lambda x: upper(x)), ',') AS curps FROM kyc""")
def extract_ids(spark, d):
    doc = F.col("doc_id")
    number = F.lpad((doc % 1_000_000).cast("string"), 6, "0")
    text = F.concat(
        F.lower("text"), F.lit(" rfc: "),
        F.when(doc % 3 == 0, F.lit("bba830831lj2")).otherwise(F.concat(F.lit("abc"), number, F.lit("xy1"))),
        F.lit(" r.f.c.  xyz010203aa"), (doc % 10).cast("string"), F.lit(" curp: abcd"), number, F.lit("hdfxyz01"),
    )
    return docs(spark, d).select("doc_id", text.alias("text")).select(
        "doc_id", F.array_join(ids.tax_ids(F.col("text"), "estado"), ",").alias("rfcs"),
        F.array_join(ids.person_ids(F.col("text")), ",").alias("curps"),
    )


@query("taxpayer_type", """
SELECT doc_id, CASE WHEN t LIKE '%curp%' THEN 'persona_fisica' WHEN regexp_matches(t, 'raz[oó]n social|r[ée]gimen capital') THEN 'persona_moral' ELSE 'desconocido' END AS taxpayer_type
FROM (SELECT doc_id, concat(lower(text), CASE doc_id % 4 WHEN 0 THEN ' curp: x' WHEN 1 THEN ' razón social: y' WHEN 2 THEN ' regimen capital' ELSE '' END) AS t FROM documents)""")
def taxpayer_type(spark, d):
    doc = F.col("doc_id")
    tail = F.when(doc % 4 == 0, " curp: x").when(doc % 4 == 1, " razón social: y").when(doc % 4 == 2, " regimen capital").otherwise("")
    return docs(spark, d).select("doc_id", ids.taxpayer_type(F.concat(F.lower("text"), tail)).alias("taxpayer_type"))


_CERT = """cert AS (SELECT doc_id, concat(text, chr(10), CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat('RFC: ABC', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'XY', doc_id % 10) END, chr(10),
 CASE WHEN doc_id % 2 = 0 THEN concat('CURP: ABCD', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'HDFXYZ01', chr(10), 'Nombre (s): ANA ', doc_id, chr(10), 'Primer Apellido: PEREZ', chr(10))
 ELSE concat('Denominación/Razón Social: EMPRESA ', doc_id, chr(10), 'Régimen Capital: SOCIEDAD ANONIMA', chr(10)) END,
 'Código Postal: ', lpad((doc_id % 100000)::VARCHAR, 5, '0'), chr(10), 'Nombre de la Colonia: CENTRO ', doc_id % 3, chr(10)) AS text FROM documents)"""


def _certs(spark, d):
    doc = F.col("doc_id")
    number = F.lpad((doc % 1_000_000).cast("string"), 6, "0")
    nl = F.lit("\n")
    person = F.concat(F.lit("CURP: ABCD"), number, F.lit("HDFXYZ01\nNombre (s): ANA "), doc.cast("string"), F.lit("\nPrimer Apellido: PEREZ\n"))
    company = F.concat(F.lit("Denominación/Razón Social: EMPRESA "), doc.cast("string"), F.lit("\nRégimen Capital: SOCIEDAD ANONIMA\n"))
    return docs(spark, d).select("doc_id", F.concat(
        F.col("text"), nl,
        F.when(doc % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("RFC: ABC"), number, F.lit("XY"), (doc % 10).cast("string"))), nl,
        F.when(doc % 2 == 0, person).otherwise(company),
        F.lit("Código Postal: "), F.lpad((doc % 100_000).cast("string"), 5, "0"), nl,
        F.lit("Nombre de la Colonia: CENTRO "), (doc % 3).cast("string"), nl,
    ).alias("text"))


@query("certificate_fields", with_ctes(_CERT) + """
, f AS (SELECT doc_id, CASE WHEN lower(text) LIKE '%curp%' THEN 'persona_fisica' WHEN regexp_matches(lower(text), 'raz[oó]n social|r[ée]gimen capital') THEN 'persona_moral' ELSE 'desconocido' END AS taxpayer_type,
 nullif(regexp_extract(text, '(?i)rfc:\\s+([a-z0-9]{12,13})', 1), '') AS id, text FROM cert)
SELECT doc_id, taxpayer_type, id AS rfc, CASE WHEN id IS NOT NULL THEN nullif(regexp_extract(text, '(?i)c[oó]digo postal:\\s*(\\d{5})', 1), '') END AS codigo_postal,
 CASE WHEN id IS NOT NULL THEN nullif(trim(regexp_extract(text, '(?i)nombre de la colonia:\\s*([^\\n]+)', 1)), '') END AS colonia,
 CASE WHEN id IS NOT NULL AND taxpayer_type = 'persona_fisica' THEN nullif(trim(regexp_extract(text, '(?i)nombre \\(s\\):\\s+([^\\n]+)\\n', 1)), '') END AS nombre,
 CASE WHEN id IS NOT NULL AND taxpayer_type = 'persona_fisica' THEN nullif(regexp_extract(text, '(?i)curp:\\s+([a-z0-9]{18})', 1), '') END AS curp,
 CASE WHEN id IS NOT NULL AND taxpayer_type = 'persona_moral' THEN nullif(trim(regexp_extract(text, '(?i)raz[oó]n social:\\s+([^\\n]+)', 1)), '') END AS razon_social,
 CASE WHEN id IS NOT NULL AND taxpayer_type = 'persona_moral' THEN nullif(trim(regexp_extract(text, '(?i)r[eé]gimen capital:\\s+([a-z\\s]+)\\n', 1)), '') END AS regimen_capital
FROM f""")
def certificate_fields(spark, d):
    return screening.parse_certificates(_certs(spark, d)).select(
        "doc_id", "taxpayer_type", "rfc", "codigo_postal", "colonia", "nombre", "curp", "razon_social", "regimen_capital"
    )


@query("certificate_activities", """
WITH c AS (SELECT doc_id, i AS k FROM documents, LATERAL (SELECT unnest(range(1, 4)) AS i) u WHERE i <= doc_id % 4)
SELECT doc_id, k AS position, concat('comercio ', doc_id % 9) AS activity, (k * 10)::DOUBLE AS share, '01/01/2019' AS start, CASE WHEN k = 2 THEN '31/12/2020' END AS "end" FROM c""")
def certificate_activities(spark, d):
    doc = F.col("doc_id")
    row = lambda k, end: F.concat(
        F.lit(f"{k} comercio "), (doc % 9).cast("string"), F.lit(f" {k * 10} 01/01/2019{end}\n")
    )
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\ncurp: x\n"), F.when(doc % 4 >= 1, row(1, "")).otherwise(""), F.when(doc % 4 >= 2, row(2, " 31/12/2020")).otherwise(""),
        F.when(doc % 4 >= 3, row(3, "")).otherwise(""),
    )
    return screening.certificate_activities(docs(spark, d).select("doc_id", text.alias("text")))


_STMT = """stmt AS (SELECT doc_id, lower(concat(left(text, 200), CASE doc_id % 5 WHEN 0 THEN concat(' BANCO SANTANDER r.f.c. ABC', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'XY1 comisiones cobradas x ', doc_id, '.50 depósitos 1,', lpad((doc_id % 1000)::VARCHAR, 3, '0'), '.25')
 WHEN 1 THEN concat(' Banca Afirme R.F.C. XYZ', lpad((doc_id % 1000000)::VARCHAR, 6, '0'), 'AB2 total de comisiones $ 10.00 depositos $ 5', lpad((doc_id % 1000)::VARCHAR, 3, '0'), '.00') WHEN 2 THEN ' bankaool' ELSE '' END, substr(text, 201))) AS text FROM documents)"""


def _statements(spark, d):
    doc = F.col("doc_id")
    six, three = F.lpad((doc % 1_000_000).cast("string"), 6, "0"), F.lpad((doc % 1000).cast("string"), 3, "0")
    head = (
        F.when(doc % 5 == 0, F.concat(F.lit(" BANCO SANTANDER r.f.c. ABC"), six, F.lit("XY1 comisiones cobradas x "), doc.cast("string"), F.lit(".50 depósitos 1,"), three, F.lit(".25")))
        .when(doc % 5 == 1, F.concat(F.lit(" Banca Afirme R.F.C. XYZ"), six, F.lit("AB2 total de comisiones $ 10.00 depositos $ 5"), three, F.lit(".00")))
        .when(doc % 5 == 2, F.lit(" bankaool")).otherwise(F.lit(""))
    )
    return docs(spark, d).select("doc_id", F.concat(F.left("text", F.lit(200)), head, F.substr(F.col("text"), F.lit(201))).alias("text"))


@query("detect_bank", with_ctes(_STMT) + """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'SANTANDER' WHEN 1 THEN 'AFIRME' WHEN 2 THEN 'BANKAOOL' END AS bank,
 CASE doc_id % 5 WHEN 0 THEN upper(nullif(regexp_extract(text, 'r\\.f\\.c\\.\\s*([a-zñ&]{3,4}\\d{6}[a-z0-9]{2,3})', 1), '')) WHEN 1 THEN upper(nullif(regexp_extract(text, 'r\\.f\\.c\\.\\s*([a-zñ&]{3,4}\\d{6}[a-z0-9]{2,3})', 1), ''))
 WHEN 2 THEN upper(nullif(regexp_extract(text, 'rfc\\s+([a-zA-ZÑ&]{3,4}\\d{6}[a-zA-Z0-9]{2,3})', 1), '')) END AS rfc,
 CASE doc_id % 5 WHEN 0 THEN try_cast(regexp_extract(text, 'comisiones cobradas\\s*.+?\\s*([\\d,]+\\.\\d{2})', 1) AS DOUBLE) WHEN 1 THEN 10.0 END AS fees,
 CASE doc_id % 5 WHEN 0 THEN try_cast(replace(regexp_extract(text, 'dep.{0,10}sitos\\s*\\$?([\\d,]+\\.\\d{2})', 1), ',', '') AS DOUBLE)
 WHEN 1 THEN try_cast(regexp_extract(text, 'dep[oó]sitos\\s+\\$\\s*([\\d,]+\\.\\d{2})', 1) AS DOUBLE) END AS deposits FROM stmt""")
def detect_bank(spark, d):
    return screening.detect_bank(_statements(spark, d)).select("doc_id", "bank", "rfc", "fees", "deposits")


@query("is_digital_text", with_ctes(_STMT) + "SELECT doc_id, length(trim(text)) > 50 AND regexp_matches(text, 'banco|banca|cliente|estado de cuenta|rfc|periodo') AS digital FROM stmt")
def is_digital_text(spark, d):
    return _statements(spark, d).select("doc_id", screening.is_digital_text(F.lower("text")).alias("digital"))


@query("viability_score", with_ctes(_STMT) + """
, p AS (SELECT doc_id, trim(CASE WHEN doc_id % 13 = 0 THEN concat('recibo de nómina ', text) WHEN doc_id % 17 = 0 THEN 'ñ' ELSE text END) AS b,
 CASE doc_id % 6 WHEN 0 THEN 'edo_cta' WHEN 1 THEN 'Factura' ELSE 'doc' END AS name, doc_id % 4 = 0 AS img FROM stmt),
q AS (SELECT *, regexp_matches(b, 'recibo de nómina') OR name = 'Factura' AS veto, length(b) > 50 AND length(regexp_replace(b, '[^a-zA-Z0-9\\s]', '', 'g')) / length(b) > 0.4 AS rl FROM p),
s AS (SELECT *, CASE WHEN veto THEN 0 ELSE (CASE WHEN name = 'edo_cta' THEN 40 ELSE 0 END) + CASE WHEN rl AND regexp_matches(b, 'banco|banca|cliente|estado de cuenta|rfc|periodo') THEN 30 ELSE 0 END
 + CASE WHEN rl AND (regexp_matches(b, '[a-zñ&]{3,4}\\d{6}[a-z0-9]{3}') OR regexp_matches(b, '\\b\\d{18}\\b')) THEN 30 ELSE 0 END + CASE WHEN rl AND doc_id % 5 <= 2 THEN 30 ELSE 0 END END AS score FROM q)
SELECT doc_id, score, NOT veto AND (score >= 50 OR (img AND score >= 40)) AS viable, NOT veto AND (score >= 50 OR (img AND score >= 40)) AND NOT rl AS needs_vision FROM s""")
def viability_score(spark, d):
    doc = F.col("doc_id")
    rows = _statements(spark, d).select(
        "doc_id",
        F.when(doc % 13 == 0, F.concat(F.lit("Recibo de nómina "), "text")).when(doc % 17 == 0, F.lit("ñ")).otherwise(F.col("text")).alias("text"),
        F.when(doc % 6 == 0, "edo_cta").when(doc % 6 == 1, "Factura").otherwise("doc").alias("name"),
        (doc % 4 == 0).alias("has_images"),
    )
    return screening.score_documents(rows).select("doc_id", "score", "viable", "needs_vision")


@query("certificate_regimes", """
SELECT doc_id, 'Régimen de Sueldos' AS regime, '01/02/2019' AS start, NULL::VARCHAR AS end FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'Régimen General de Ley', '03/04/2018', '05/06/2020' FROM documents WHERE doc_id % 3 = 1""")
def certificate_regimes(spark, d):
    doc = F.col("doc_id")
    person = "\ncurp: x\n Régimen de Sueldos 01/02/2019\n Regimen 123 01/02/2019\n"
    company = "\nrazón social: y\nver Régimen General de Ley 03/04/2018 05/06/2020\n"
    tail = F.when(doc % 3 == 0, person).when(doc % 3 == 1, company).otherwise("")
    return screening.certificate_regimes(docs(spark, d).select("doc_id", F.concat("text", tail).alias("text")))


@query("clean_for_export", "SELECT doc_id, trim(regexp_replace(replace(concat(text, chr(7)), chr(7), ''), '\\s+', ' ', 'g')) AS clean FROM documents")
def clean_for_export(spark, d):
    return docs(spark, d).select("doc_id", X.clean_for_export(F.concat("text", F.lit("\x07"))).alias("clean"))


@query("parse_kv_block", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE concat('bank', doc_id % 5) END AS banco, CASE WHEN doc_id % 4 = 3 OR doc_id % 2 = 0 THEN NULL ELSE concat('R::', doc_id) END AS rfc,
 CASE WHEN doc_id % 4 <> 3 THEN lang END AS lang FROM documents""")
def parse_kv_block(spark, d):
    doc = F.col("doc_id")
    rfc = F.when(doc % 2 == 0, F.lit("NULL")).otherwise(F.concat(F.lit("R::"), doc.cast("string")))
    bank = F.concat(F.lit("bank"), (doc % 5).cast("string"))
    pairs = F.concat(F.lit(" <<<TOON_START>>>\nbanco:: x\nrfc:: "), rfc, F.lit("\nlang::"), "lang", F.lit("\nbanco::"), bank, F.lit("\n<<<TOON_END>>> fin"))
    grid = F.concat(F.lit("<<<TOON_START>>>\nbanco ||| rfc|||lang\n"), bank, F.lit("|||"), rfc, F.lit("|||"), "lang", F.lit("<<<TOON_END>>>"))
    block = F.when(doc % 4 == 3, F.lit("nada")).when(doc % 3 == 0, grid).otherwise(pairs)
    text = F.concat("text", block)
    return docs(spark, d).select("doc_id", "lang", parse.parse_block(text).alias("m")).select(
        "doc_id", F.col("m")["banco"].alias("banco"), F.col("m")["rfc"].alias("rfc"), F.col("m")["lang"].alias("lang")
    )


@query("error_rows", """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'ERROR_CIFRADO' ELSE 'ERROR_LECTURA' END AS bank, 'fallido' AS status,
 CASE WHEN doc_id % 6 = 0 THEN 'Documento protegido con contraseña.' ELSE concat('cannot read ', source) END AS message, 0.0::DOUBLE AS deposits, 0.0::DOUBLE AS charges FROM documents WHERE doc_id % 3 = 0""")
def error_rows(spark, d):
    doc = F.col("doc_id")
    error = F.when(doc % 6 == 0, "file is encrypted").when(doc % 3 == 0, F.concat(F.lit("cannot read "), "source"))
    return intake.error_rows(docs(spark, d).withColumn("error", error)).select("doc_id", "bank", "status", "message", "deposits", "charges")


# Line rules made of words that occur in the documents.
_LINES = {
    "src0": LineRules(("the and",), ("is",), ("ation", "le la")),
    "src1": LineRules((), ("a",), ("de {n}", "thereon", "ent ")),
}


@query("bank_line_rules", """
WITH t AS (SELECT doc_id, source, lower(text) AS low, string_split(lower(text), chr(10)) AS l, doc_id % 3 <> 0 AS is_in FROM documents)
SELECT doc_id, CASE WHEN NOT is_in THEN 'general' WHEN contains(low, 'traspaso entre cuentas') THEN 'traspaso entre cuentas' WHEN contains(low, 'financiamiento') THEN 'financiamiento' WHEN contains(low, 'credito') THEN 'crédito'
 WHEN CASE source WHEN 'src0' THEN contains(low, 'the and') OR (contains(l[1], 'is') AND len(list_filter(l[2:], lambda x: regexp_matches(x, 'ation|le la'))) > 0)
 WHEN 'src1' THEN contains(l[1], 'a') AND len(list_filter(l[2:], lambda x: regexp_matches(x, 'de \\d+|thereon|ent '))) > 0
 ELSE regexp_matches(low, 'their|netpay') END THEN 'tpv' ELSE 'general' END AS label FROM t""")
def bank_line_rules(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("source").alias("bank"), F.col("text").alias("description"),
                                 F.when(F.col("doc_id") % 3 != 0, "abono").otherwise("cargo").alias("kind"))
    return bank_lines.bank_line_labels(rows, _LINES, ("their", "netpay")).select("doc_id", "label")
