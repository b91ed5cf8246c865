"""Risk indicators, registries, economic activities, key-value tables, and feed assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.dates import seniority_years
from balanza.functions.money import guarantee_amount, guarantee_currency

EMPTY = "array<variant>"


def members(body: Column) -> Column:
    """Items of a response: a list, or the list under hydra:member, data or respuesta."""
    def at(path):
        items = F.try_variant_get(body, path, EMPTY)
        return F.when(F.size(items) > 0, items)

    listed = F.try_variant_get(body, "$", EMPTY)
    return F.coalesce(listed, at("$['hydra:member']"), at("$.data"), at("$.respuesta"), F.array().cast(EMPTY))


def risk_indicators(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per indicator of the first risk object: name, value text and YES/NO."""
    first = F.coalesce(F.get(members(F.col(body)), F.lit(0)), F.col(body))
    fields = F.try_variant_get(first, "$", "map<string,variant>")
    return rows.select(key, F.explode(fields).alias("indicator", "v")).filter(F.schema_of_variant("v").startswith("OBJECT")).select(
        key, "indicator", F.try_variant_get("v", "$.value", "string").alias("value"),
        F.when(F.coalesce(F.try_variant_get("v", "$.risky", "boolean"), F.lit(False)), F.lit("SÍ")).otherwise(F.lit("NO")).alias("risky"),
    )


def kv_rows(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Scalar fields of an object as (key, name, value) rows."""
    fields = F.try_variant_get(F.col(body), "$", "map<string,variant>")
    kind = F.schema_of_variant("v")
    return rows.select(key, F.explode(fields).alias("name", "v")).filter(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(
        key, "name", F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("None")).alias("value")
    )


def list_rows(rows: DataFrame, key: str, columns, body: str = "body") -> DataFrame:
    """Objects of a list, a single object or a keyed collection as rows of the named columns."""
    value = F.col(body)
    single = F.try_variant_get(value, f"$.{columns[0]}", "variant")
    items = F.coalesce(
        F.try_variant_get(value, "$", EMPTY), F.when(single.isNotNull(), F.array(value)), F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    )
    return rows.select(key, F.explode(items).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT")).select(
        key, *[F.coalesce(F.try_variant_get("v", f"$.{c}", "string"), F.lit("")).alias(c) for c in columns]
    )


def registry_records(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Company records: folio, date, state, name, and partners and acts as VARIANT arrays."""
    v = F.col(body)

    def text(path):
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit("N/A"))

    def listed(*paths):
        return F.coalesce(*[F.try_variant_get(v, p, EMPTY) for p in paths], F.array().cast(EMPTY))

    return rows.select(
        key, text("$.fme").alias("folio"), F.left(text("$.fechaDeInscripcion"), F.lit(10)).alias("date"),
        text("$.entidadFederativa").alias("state"), text("$.nombreRazonSocial").alias("business_name"),
        listed("$.socios", "$.socio").alias("partners"), listed("$.actos", "$.acto").alias("acts"),
    )


def registry_partners(records: DataFrame, key: str) -> DataFrame:
    """One row per partner: joined name, shares, value and status."""
    p = F.col("p")

    def get(path, kind="string"):
        return F.try_variant_get(p, path, kind)

    name = F.trim(F.concat_ws(" ", *[F.coalesce(get(f"$.{n}"), F.lit("")) for n in ("nombre", "apellidoPaterno", "apellidoMaterno")]))
    return records.select(key, "folio", F.explode("partners").alias("p")).select(
        key, "folio", F.coalesce(F.nullif(name, F.lit("")), F.lit("N/A")).alias("name"), F.coalesce(get("$.acciones"), F.lit("N/A")).alias("shares"),
        F.coalesce(get("$.valor", "double"), get("$.valor").try_cast("double"), F.lit(0.0)).alias("value"), F.coalesce(get("$.estatus"), F.lit("N/A")).alias("status"),
    )


def registry_acts(records: DataFrame, key: str) -> DataFrame:
    """One row per registered act: date, description and document number."""
    a = F.col("a")

    def get(*paths):
        return F.coalesce(*[F.nullif(F.try_variant_get(a, p, "string"), F.lit("")) for p in paths], F.lit("N/A"))

    return records.select(key, "folio", F.explode("acts").alias("a")).select(
        key, "folio", F.left(get("$.fechaDeInscripcion", "$.fechaDeIngreso"), F.lit(10)).alias("date"),
        get("$.formaPrecodificada", "$.acto").alias("description"), get("$.numeroDeDocumento").alias("document_number"),
    )


def registry_guarantees(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Movable guarantees: creditor, amount and currency out of a text, capitalized status."""
    v = F.col(body)

    def text(path, missing="N/A"):
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(missing))

    note = text("$.boleta.datos_de_la_garantia_mobiliaria.monto_maximo_garantizado_y_moneda", "0")
    kind = text("$.tipo")
    return rows.select(
        key, text("$.numeroDeGarantia").alias("guarantee_number"), F.left(text("$.fecha"), F.lit(10)).alias("created"),
        text("$.boleta.datos_del_asiento.vigencia").alias("validity"),
        text("$.boleta.datos_del_acreedor.nombre_denominacion_o_razon_social").alias("creditor"),
        guarantee_amount(note).alias("amount"), guarantee_currency(note).alias("currency"),
        F.concat(F.upper(F.left(kind, F.lit(1))), F.lower(F.substr(kind, F.lit(2)))).alias("status"),
    )


def activities(rows: DataFrame, as_of) -> DataFrame:
    """Economic activities with exact years since their start date, 0 when the date is bad."""
    return rows.withColumns({
        "name": F.coalesce("name", F.lit("N/A")),
        "seniority_years": seniority_years(F.try_to_date(F.left("start_date", F.lit(10)), "yyyy-MM-dd"), as_of),
    })


def latest(df: DataFrame, keys, ts: str, tie: str | None = None) -> DataFrame:
    """The newest record per key, as a grouped maximum."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def credential_status(status: Column) -> Column:
    """``valid`` is active, another status inactive, none not_found."""
    return F.when(status.isNull(), F.lit("not_found")).when(status == "valid", F.lit("active")).otherwise(F.lit("inactive"))


def resolve_name(spine: DataFrame, names: DataFrame, key: str = "taxpayer") -> DataFrame:
    """Business name by source priority (issued, received, registry), else the id itself."""
    best = names.filter(F.coalesce("name", F.lit("")) != "").groupBy(key).agg(F.min_by("name", F.struct("priority", "name")).alias("name"))
    return spine.select(key).distinct().join(best, key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))


def assemble(spine: DataFrame, feeds: dict[str, tuple[DataFrame, dict]], key: str = "taxpayer") -> DataFrame:
    """Left joins of one-row-per-taxpayer feeds onto the taxpayers, with defaults for missing ones."""
    joined = reduce(lambda left, feed: left.join(feed[0], key, "left"), feeds.values(), spine.select(key).distinct())
    defaults = {c: v for _, (_, d) in feeds.items() for c, v in d.items()}
    return joined.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()})


def obligations(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Omitted tax obligations of a compliance opinion: tax and periods, one row each."""
    items = F.coalesce(F.try_variant_get(F.col(body), "$.obligaciones_omitidas", EMPTY), F.array().cast(EMPTY))

    def text(path):
        return F.coalesce(F.try_variant_get("o", path, "string"), F.lit("N/A"))

    return rows.select(key, F.explode(items).alias("o")).select(key, text("$.impuesto").alias("tax"), text("$.periodos").alias("periods"))
