"""Movement tags: weight and keyword list per tag. A rule set is plain data and can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TagRule:
    tag: str
    weight: int
    keywords: tuple[str, ...] = field(default_factory=tuple)


# Tag names, weights and keywords, in rule order (ties go to the earlier rule).
TAG_RULES = (
    TagRule("EXCLUIDA", 9999, (
        "comision", "com.", "-com x", "cliente stripe", "imss", "spei recibidove por mas",
        "spei recibidomifel", "kpay", "apiapic", "cf tech",
    )),
    TagRule("IVA", 1000, ("iva",)),
    TagRule("COMISION_CR", 100, (
        "comision aplicacion de tasas de descuento de cr", "com. tasa de descuento cre",
        "com tasa de descuento cre", "comision descuento cr", "com descuento cr", "venta tpv cr",
        "ventas crédito",
    )),
    TagRule("COMISION_DB", 100, (
        "comision aplicacion de tasas de descuento de db", "com. tasa de descuento deb",
        "com tasa de descuento deb", "comision descuento db", "com descuento db", "venta tpv db",
        "ventas débito", "ventas debito",
    )),
    TagRule("COMISION_AMEX", 100, (
        "comision amex", "com amex", "venta nal. amex", "venta nal amex", "american express", "amexco",
    )),
    TagRule("COMISION_MIXTA", 90, (
        "com vtas", "com. vtas", "comision ventas", "comision vtas", "net pay", "netpay", "clip",
        "izettle", "zettle", "terminales punto de venta", "tpv", "comision", "comisiones",
        "tasa de descuento", "descuento",
    )),
    TagRule("TPV", 80, (
        "terminales punto de venta", "punto de venta", "tpv", "terminal", "evopay", "clip", "izettle",
        "netpay", "mp agregador", "mpagregador", "getnet", "pocket de latinoameric",
        "pocket de billpocket", "billpocket", "spei amexco", "data merchant services",
        "abrexpress company mexicsa", "net pay", "payclip", "pocket", "kiwi", "kiwi international",
        "zettle", "gananciasclip", "ganancias clip", "deposito bpu", "depositobpu",
        "net pay sapi de cv", "srpago", "sr pago", "señor pago", "señorpago", "wuzi", "bn-nts",
        "vta. cre", "vta. deb", "pay sapi de cv", "first data", "fiserv", "evopay mx", "evopaymx",
        "evopayments", "bzpay", "bz pay", "bzpayments", "bz payments", "bzpay solutions",
        "bz pay solutions", "psm payment services mexico sa de cv", "ventas credito",
        "ventas debito", "quark payments", "quark", "quark payment solutions",
        "quark payments solutions", "quark payment solutions sa de cv", "quarkpayments", "druo",
        "druo sa de cv", "bpu",
    )),
    TagRule("FINANCIAMIENTO", 50, (
        "prestamo", "anticipo de ventas", "anticipo de venta", "financiamiento", "anticipo", "adelanto",
        "adelanto de ventas", "préstamo", "crédito", "otorgamiento de crédito",
        "comision por apertura", "credito", "fondeo", "desembolso de credito",
        "desembolso de crédito",
    )),
    TagRule("PAGO_FINANCIAMIENTO", 50, (
        "pago interes de credito", "pago capital de credito", "pago interes moratorio de credito",
        "pago preferente pm no crm cred", "domiciliacion", "sofom", "cgo domiciliacion",
        "pago de capital", "intereses exento tasa", "pago credito", "retiro por domiciliacion",
        "pago a interes-capoital de credito", "pago a interes-capital de credito",
        "cargo por intereses de credito", "cargo capital de credito", "domi-druo sa de cv",
    )),
    TagRule("TRASPASO", 40, (
        "traspaso entre cuentas", "traspaso cuentas propias", "traspaso entre cuentas propias",
        "transferencia entre cuentas propias", "transferencia entre cuentas",
        "traspaso entre mis cuentas", "traspaso a cuenta propia", "transferencia a cuenta propia",
        "traspaso a mis cuentas", "transferencia a mis cuentas", "transferencia cuentas propias",
        "traspaso tarjeta", "traspaso a cuenta de terceros",
    )),
    TagRule("EFECTIVO", 30, (
        "deposito efectivo", "deposito en efectivo", "dep.efectivo", "deposito efectivo corresponsal",
    )),
    TagRule("BMRCASH", 30, (
        "bmrcash ref", "bmrcash", "mercado libre", "mercadolibre", "mercado pago", "mercadopago",
    )),
    TagRule("MORATORIOS", 20, (
        "cargo por moratorio", "intereses moratorios", "recargo", "recargos", "penalización",
        "penalizaciones", "pena convencional", "penalizacion", "penalizaciones convencionales",
        "cargo por moratorios", "interes moratorio", "cargo por intereses moratorios",
        "recargo por intereses moratorios", "penaliz",
    )),
)

# A domiciled loan payment written without a keyword.
LOAN_PAYMENT_PATTERN = r"\bdru\d+\s*domiciliacion\b"

# Tag groups and category names used by the conflict rules and the totals.
FEE_TAGS = ("COMISION_CR", "COMISION_DB", "COMISION_AMEX", "COMISION_MIXTA")
TOTAL_CATEGORIES = (
    "EFECTIVO", "TRASPASO_ABONO", "TRASPASO_CARGO", "FINANCIAMIENTO", "BMRCASH", "MORATORIOS", "TPV",
    "COMISION_CR", "COMISION_DB", "COMISION_AMEX", "COMISION_TPV_MIXTA", "PAGO_FINANCIAMIENTO",
)
PROTECTED_CATEGORIES = (
    "TPV", "EFECTIVO", "BMRCASH", "FINANCIAMIENTO", "PAGO_FINANCIAMIENTO", "COMISION_CR",
    "COMISION_DB", "COMISION_AMEX", "COMISION_TPV_MIXTA", "MORATORIOS", "IVA",
)
JUNK_CATEGORY = "BASURA_OCR"
JUNK_KIND = "importe"

# Texts of the classification reason.
REASON_JUNK = "Descarte automático: Identificado como Basura OCR / CFDI."
REASON_LOAN_PAYMENT = "Defensa de cargos: Pago a financiamiento tiene prioridad máxima."
REASON_IVA = "Regla de supremacía: IVA mata cualquier otra categoría."
REASON_FEE = "Regla de supremacía: Comisión detectada ({tag})."
REASON_EXCLUDED = "Muerte Súbita: Contiene palabra en lista de exclusiones."
REASON_TPV = "Matriz de conflictos: TPV tiene prioridad sobre financiamientos/traspasos."
REASON_WEIGHT = "Resolución heurística: Gana el Tag '{tag}' con peso de {weight} puntos."
REASON_LABEL = "Delegado a IA: Clasificación semántica en lote."
REASON_NO_LABEL = "IA Fallback: No se pudo clasificar, asignado a GENERAL."


def with_lender(rules, lender: str) -> tuple[TagRule, ...]:
    """Adds the loan-payment wordings that carry a lender's own name."""
    name = lender.lower()
    own = (f"pago {name}", f"{name} fin sapi")
    return tuple(
        TagRule(r.tag, r.weight, r.keywords + own) if r.tag == "PAGO_FINANCIAMIENTO" else r for r in rules
    )


def rules_from_rows(rows) -> tuple[TagRule, ...]:
    """Rule set from (tag, weight, ord, keyword) rows of a small rule table."""
    grouped: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for tag, weight, order, keyword in rows:
        grouped.setdefault((tag, weight), []).append((order, keyword))
    return tuple(TagRule(t, w, tuple(k for _, k in sorted(ks))) for (t, w), ks in grouped.items())
