"""Document screening: viability, bank and identity fields, coverage and congruence per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions import dates as D
from balanza.functions.ids import taxpayer_type
from balanza.functions.text import any_of
from balanza.rules import banks as B, certificates as C


def is_digital_text(text: Column, min_length: int = 50) -> Column:
    """Text long enough and with a statement word in it."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(clean) > min_length) & clean.rlike(any_of(B.STATEMENT_WORDS))


def bank_alias_pattern(banks=B.BANKS) -> str:
    return "|".join(a for cfg in banks.values() for a in cfg["alias"])


def score_documents(df: DataFrame, text: str = "text", name: str = "name", images: str = "has_images", banks=B.BANKS, rules=B) -> DataFrame:
    """Adds ``score``, ``viable``, ``needs_vision`` and ``verdict``.

    Vetoed words reject at once. Points: 40 for the file name, and 30 each for statement words, an
    id or account number, and a known bank, these three only on readable text. 50 points pass;
    images pass with 40.
    """
    body = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))))
    label = F.lower(F.coalesce(F.col(name), F.lit("")))
    shown = F.coalesce(F.col(images), F.lit(False))
    veto = body.rlike(any_of(rules.VETO_TEXT)) | label.rlike(any_of(rules.VETO_NAME))
    named = label.rlike(any_of(rules.NAME_HINTS))
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(body, r"[^a-zA-Z0-9\s]", "")), F.length(body)), F.lit(0.0))
    real = (F.length(body) > 50) & (share > 0.4)
    with_id = body.rlike(r"[a-zñ&]{3,4}\d{6}[a-z0-9]{3}") | body.rlike(r"\b\d{18}\b")
    points = (
        F.when(named, 40).otherwise(0)
        + F.when(real & body.rlike(any_of(rules.STATEMENT_WORDS)), 30).otherwise(0)
        + F.when(real & with_id, 30).otherwise(0)
        + F.when(real & body.rlike(bank_alias_pattern(banks)), 30).otherwise(0)
    )
    out = df.withColumns({"_veto": veto, "_real": real, "_shown": shown, "score": F.when(veto, F.lit(0)).otherwise(points)})
    special = F.col("_shown") & (F.col("score") >= 40)
    passed = ~F.col("_veto") & ((F.col("score") >= 50) | special)
    verdict = (
        F.when(F.col("_veto"), F.lit("Documento vetado (Detectado como CSF, Nómina o Factura)."))
        .when(~F.col("_real") & special, F.lit("PDF de imágenes/texto basura aprobado por nombre de archivo."))
        .when(~passed, F.concat(F.lit("Rechazado (Score: "), F.col("score").cast("string"), F.lit("/100). No parece un estado de cuenta válido.")))
        .when(F.col("_real"), F.concat(F.lit("Aprobado con "), F.col("score").cast("string"), F.lit(" puntos.")))
        .otherwise(F.lit("Aprobado por Caso Especial (Imagen/Basura)."))
    )
    return out.withColumns({
        "viable": passed, "needs_vision": passed & ~F.col("_real"), "verdict": verdict,
    }).drop("_veto", "_real", "_shown")


def detect_bank(df: DataFrame, text: str = "text", banks=B.BANKS) -> DataFrame:
    """Adds ``bank``, ``rfc``, ``fees`` and ``deposits`` from the statement text.

    One alternation finds the first alias in the text; the patterns of the other banks are never
    tried, because each sits in the branch of its own bank.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    alias = F.regexp_extract(low, "(" + bank_alias_pattern(banks) + ")", 1)
    bank = None
    for name, cfg in banks.items():
        hit = alias.isin(*cfg["alias"])
        bank = F.when(hit, F.lit(name)) if bank is None else bank.when(hit, F.lit(name))

    def field(kind: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, cfg in banks.items():
            patterns = cfg.get(kind) or []
            if patterns:
                joined = "|".join(f"(?:{p})" for p in patterns)
                groups = [
                    F.get(F.filter(F.regexp_extract_all(F.col("_low"), F.lit(joined), F.lit(i + 1)), lambda v: v != ""), F.lit(0))
                    for i in range(len(patterns))
                ]
                out = out.when(F.col("_bank") == name, F.coalesce(*groups) if len(groups) > 1 else groups[0])
        return out

    def number(kind: str) -> Column:
        return F.translate(field(kind), ",$", "").try_cast("double")

    found = df.withColumns({"_low": low}).withColumn("_bank", bank)
    return found.withColumns({
        "bank": F.upper("_bank"), "rfc": F.upper(field("rfc")), "fees": number("comisiones"), "deposits": number("depositos"),
    }).drop("_low", "_bank")


def parse_certificates(df: DataFrame, text: str = "text") -> DataFrame:
    """Certificate fields as columns; without a tax id the row has no fields."""
    body = F.col(text)
    kind = taxpayer_type(F.lower(body))

    def grab(pattern):
        return F.nullif(F.trim(F.regexp_extract(body, pattern, 1)), F.lit(""))

    fields = {name: grab(p) for name, p in C.COMMON_FIELDS.items()}
    person = {name: grab(p) for name, p in C.PERSON_FIELDS.items()}
    company = {name: grab(p) for name, p in C.COMPANY_FIELDS.items()}
    out = df.withColumn("taxpayer_type", kind)
    is_person, is_company = F.col("taxpayer_type") == "persona_fisica", F.col("taxpayer_type") == "persona_moral"
    known = is_person | is_company
    has_id = known & fields["rfc"].isNotNull()
    cols = {name: F.when(has_id, c) for name, c in fields.items()}
    for name in {**person, **company}:
        cols[name] = F.when(has_id & is_person, person[name] if name in person else F.lit(None)).when(
            has_id & is_company, company[name] if name in company else F.lit(None)
        )
    return out.withColumns(cols)


def certificate_activities(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per economic activity of a certificate."""
    body = F.col(text)
    company = taxpayer_type(F.lower(body)) == "persona_moral"

    def rows(pattern, tail: bool):
        def group(i):
            return F.regexp_extract_all(body, F.lit(pattern), F.lit(i))

        more = group(6) if tail else F.transform(group(1), lambda v: F.lit(""))
        return F.arrays_zip(
            group(1).alias("position"), group(2).alias("activity"), group(3).alias("share"),
            group(4).alias("start"), group(5).alias("end"), more.alias("more"),
        )

    items = F.when(company, rows(C.ACTIVITY_PATTERN + C.ACTIVITY_TAIL, True)).otherwise(rows(C.ACTIVITY_PATTERN, False))
    return df.select(key, F.explode(items).alias("a")).select(
        key, F.col("a.position").cast("int").alias("position"),
        F.trim(F.concat_ws(" ", F.trim("a.activity"), F.trim("a.more"))).alias("activity"),
        F.col("a.share").cast("double").alias("share"), F.col("a.start").alias("start"), F.nullif(F.col("a.end"), F.lit("")).alias("end"),
    )


def certificate_regimes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per tax regime of a certificate; names with digits are passed over."""
    body = F.col(text)
    company = taxpayer_type(F.lower(body)) == "persona_moral"

    def rows(pattern):
        return F.arrays_zip(*[
            F.regexp_extract_all(body, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "regime"), (2, "start"), (3, "end"))
        ])

    items = F.when(company, rows(C.REGIME_PATTERN_COMPANY)).otherwise(rows(C.REGIME_PATTERN_PERSON))
    out = df.select(key, F.explode(items).alias("r")).select(
        key, F.trim("r.regime").alias("regime"), F.col("r.start").alias("start"), F.nullif(F.col("r.end"), F.lit("")).alias("end")
    )
    return out.filter(~F.col("regime").rlike(r"\d"))


def certificate_defaults(df: DataFrame) -> DataFrame:
    """Trade name from the name parts where it is blank; placeholder neighbourhoods to NULL."""
    parts = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("nombre", "primer_apellido", "segundo_apellido")]
    trade = F.nullif(F.trim("nombre_comercial"), F.lit(""))
    area = F.trim("colonia")
    return df.withColumns({
        "nombre_comercial": F.coalesce(trade, F.nullif(F.concat_ws(" ", *parts), F.lit(""))),
        "colonia": F.when((area != "") & ~F.lower(area).isin(*C.EMPTY_NEIGHBOURHOODS), area),
    })


def period_coverage(light: DataFrame, as_of, job: str = "job_id", period: str = "period") -> DataFrame:
    """Per job: whether months -1..-3 or -2..-4 are all there, and the message that says so.

    ``period`` is ``MM-YYYY``. Only four flags per job are aggregated.
    """
    now = D.month_start(D.as_date(as_of))
    months = {i: F.date_format(F.add_months(now, -i), "MM-yyyy") for i in (1, 2, 3, 4)}
    flags = light.groupBy(job).agg(
        *[F.coalesce(F.bool_or(F.col(period) == m), F.lit(False)).alias(f"_m{i}") for i, m in months.items()]
    )

    def missing(ids):
        return F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"_m{i}"), months[i]) for i in ids])))

    names = F.array(*[F.lit(n) for n in D.SPANISH_MONTH_NAMES])
    gaps = flags.withColumns({"_a": missing((1, 2, 3)), "_b": missing((2, 3, 4))}).withColumns({
        "complete": (F.size("_a") == 0) | (F.size("_b") == 0),
        "missing": F.when(F.size("_a") <= F.size("_b"), F.col("_a")).otherwise(F.col("_b")),
    })
    listed = F.transform(
        F.col("missing"), lambda m: F.concat(F.element_at(names, F.left(m, F.lit(2)).cast("int")), F.lit(" "), F.right(m, F.lit(4)))
    )
    text = F.concat(
        F.lit("Faltan al menos "), F.size("missing").cast("string"),
        F.lit(" estado(s) de cuenta de los meses: "), F.array_join(listed, ", "),
    )
    return gaps.withColumn(
        "message", F.when(F.col("complete"), F.lit("Se encontraron los 3 meses requeridos.")).otherwise(text)
    ).select(job, "complete", "missing", "message")


def identity_congruence(light: DataFrame, job: str = "job_id") -> DataFrame:
    """For jobs whose covers name several holders: one row per distinct tax id or name.

    Each row has the counts and the alert of its job. The identities stay rows, so a job with very
    many of them is not gathered into one text.
    """
    pairs = light.select(
        job, F.explode(F.array(
            F.struct(F.lit("RFC").alias("kind"), F.col("rfc").alias("value")),
            F.struct(F.lit("Nombre").alias("kind"), F.col("holder").alias("value")),
        )).alias("p"),
    ).select(job, "p.kind", "p.value").filter(F.coalesce("value", F.lit("")) != "").distinct()
    counts = pairs.groupBy(job).agg(
        F.count_if(F.col("kind") == "RFC").alias("rfcs"), F.count_if(F.col("kind") == "Nombre").alias("holders")
    )
    detail = F.concat_ws(
        " y ", F.when(F.col("rfcs") > 1, F.lit("Múltiples RFCs")), F.when(F.col("holders") > 1, F.lit("Múltiples Nombres"))
    )
    mixed = counts.filter((F.col("rfcs") > 1) | (F.col("holders") > 1)).withColumn(
        "alert", F.concat(F.lit("Se detectaron estados de cuenta que podrían pertenecer a distintos titulares. ["), detail, F.lit("]"))
    )
    several = ((F.col("kind") == "RFC") & (F.col("rfcs") > 1)) | ((F.col("kind") == "Nombre") & (F.col("holders") > 1))
    return pairs.join(mixed, job).filter(several)


def kyc_checks(df: DataFrame, as_of) -> DataFrame:
    """Proof of address within three months; tax ids equal; codes equal; each NULL when unknown."""
    def same(a, b):
        known = (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
        return F.when(known, F.upper(F.col(a)) == F.upper(F.col(b)))

    return df.withColumns({
        "recent_proof": D.recent_proof(F.col("proof_end"), as_of),
        "same_rfc": same("payroll_rfc", "statement_rfc"),
        "same_qr": same("payroll_qr", "payroll2_qr"),
    })


def kyc_quality(doc_type: Column) -> Column:
    """Whether the model's fields are good enough for a document type."""
    def has(*names):
        out = F.lit(False)
        for n in names:
            out = out | (F.coalesce(F.col(n).cast("string"), F.lit("")) != "")
        return out

    return (
        F.when(doc_type.contains("nomina"), has("nombre") & has("salario_neto", "total_percepciones"))
        .when(doc_type == "estado", has("clabe", "numero_cuenta", "rfc"))
        .when(doc_type == "comprobante", has("domicilio", "inicio_periodo"))
        .otherwise(F.lit(True))
    )


def kyc_merge(df: DataFrame) -> DataFrame:
    """Code and pattern values over the model's: the last pattern match wins."""
    def last(name):
        return F.try_element_at(F.col(name), F.lit(-1))

    return df.withColumns({
        "datos_qr": F.coalesce(F.nullif(F.col("qr"), F.lit("")), F.col("datos_qr")),
        "rfc": F.coalesce(last("rfc_found"), F.col("rfc")),
        "curp": F.coalesce(last("curp_found"), F.col("curp")),
    })


def kapital_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """The addends of deposits and charges that one bank declares one by one, as columns."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = {**B.KAPITAL_DEPOSITS, **B.KAPITAL_CHARGES}
    return df.withColumns({n: F.translate(F.regexp_extract(low, p, 1), ",", "").try_cast("double") for n, p in parts.items()})
