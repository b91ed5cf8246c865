"""Card-sale rules per bank: one-line phrases, or a first-line phrase with a phrase on a later line."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LineRules:
    one_line: tuple[str, ...] = ()
    first_line: tuple[str, ...] = ()
    later_lines: tuple[str, ...] = ()


# Phrases on later lines that hold for nearly every bank. ``{6d}`` and its like stand
# for a run of that many digits, and ``{name}`` for any word.
COMMON_LATER = (
    "cobra online sapi de cv", "bn-nts {6d}", "pw online mexico sapi de cv", "liquidacion wuzi",
    "mp agregador s de rl de cv", "trans sr pago", "net pay sapi de cv",
    "getnet mexico servicios de adquirencia s", "payclip s de rl de cv",
    "pocket de latinoamerica sapi de cv", "kiwi bop sa de cv",
    "kiwi international payment technologies", "zettle by paypal", "gananciasclip",
)
_NET_SALES = LineRules(
    ("deposito ventas netas por evopaymx", "deposito ventas netas"),
    ("deposito ventas netas d tar", "deposito ventas netas d amex", "deposito spei"),
    ("por evopay", "suc", "deposito bpu", *COMMON_LATER),
)
_RECEPTION = LineRules(
    (), ("recepcion spei jp morgan", "recepcion spei santander", "recepcion spei banorte", "deposito spei"),
    ("136180018635900157", "deposito bpu", "payclip s de rl decv", *COMMON_LATER),
)

# The phrases of each bank.
BANK_LINES = {
    "bbva": LineRules(
        ("venta tarjetas", "venta tdc inter", "ventas crédito", "ventas debito", "ventas nal. amex"),
        (
            "t20 spei recibido banorte", "t20 spei recibido santander", "t20 spei recibido afirme",
            "t20 spei recibido hsbc", "t20 spei recibido citi mexico", "spei recibido banorte",
            "w02 spei recibidosantander", "deposito de tercero", "t20 spei recibido jpmorgan",
        ),
        (
            "deposito bpu", "mp agregador s de rl de cv", "anticipo {name}", "{7d}af", "{7d}sq",
            "trans sr pago", "dispersion sihay ref", "net pay sapi de cv",
            "getnet mexico servicios de adquirencia s", "payclip s de rl de cv",
            "pocket de latinoamerica sapi de cv", "cobra online sapi de cv", "kiwi bop sa de cv",
            "kiwi international payment technologies", "traspaso entre cuentas",
            "deposito de tercero", "bmrcash ref", "zettle by paypal",
            "pw online mexico sapi de cv", "liquidacion wuzi",
        ),
    ),
    "banbajío": LineRules(("deposito negocios afiliados",), ("deposito spei",), COMMON_LATER),
    "banorte": LineRules(
        ("{8d}c", "{8d}d", "dep. efectivo"),
        (
            "spei recibido", "traspaso de cta", "spei recibido del cliente red amigo",
            "pago recibido de banorte por", "deposito spei",
        ),
        (
            "ganancias clip", "clip", "amexco", "orden de netpay sapi de cv", "dal sapi de cv",
            "deposito bpu", *COMMON_LATER,
        ),
    ),
    "afirme": LineRules(
        (
            "venta tpv cr", "venta tpv db", "venta tpvcr", "venta tpvdb", "deposito efectivo",
            "deposito en efectivo", "dep.efectivo",
        ),
        ("deposito spei",), COMMON_LATER,
    ),
    "hsbc": LineRules(
        (
            "transf rec hsbcnet tpv db", "transf rec hsbcnet tpv cr", "transf rec hsbcnet dep tpv",
            "deposito bpu",
        ),
        ("deposito spei",), COMMON_LATER,
    ),
    "mifel": LineRules(
        ("vta. cre {n} {n}", "vta. deb {n} {n}", "vta cre {n} {n}", "vta deb {n} {n}"),
        (
            "vta deb", "vta cre", "transferencia spei", "transferencia spei bn",
            "transferencia spei entre", "deposito spei",
        ),
        ("dispersion de fondos", "cuentas", "deposito bpu", *COMMON_LATER),
    ),
    "scotiabank": LineRules(
        (), ("transf interbancaria spei", "deposito spei"),
        (
            "transf interbancaria spei", "deposito bpu", "amexco se", "dep",
            "pocket de latinoamerica sapi", "first data merchant services m",
            "american express company mexico", *COMMON_LATER,
        ),
    ),
    "banregio": LineRules(
        ("abono ventas tdd", "abono ventas tdc"), ("billpocket", "deposito spei", "spei banorte"),
        ("deposito bpu {10d}", *COMMON_LATER),
    ),
    "santander": LineRules(
        ("deposito ventas del dia afil",), ("abono transferencia spei hora",),
        ("recibido de stp", "deposito spei", "deposito bpu", *COMMON_LATER),
    ),
    "multiva": LineRules(
        (
            "ventas tpvs", "venta tdd", "venta tdc", "ventas tarjetas", "ventas tdc inter",
            "ventas credito", "ventas debito",
        ),
        ("spei recibido stp", "deposito spei"),
        ("latinoamerica sapi de cv", "deposito bpu {10d}", *COMMON_LATER),
    ),
    "citibanamex": _NET_SALES,
    "banamex": LineRules((*_NET_SALES.one_line, "bn-nts {6d}"), _NET_SALES.first_line, _NET_SALES.later_lines),
    "azteca": LineRules(
        (), ("transferencia spei a su favor", "deposito spei"),
        ("emisor: banorte", "emisor: santander", "payclip s de rl decv", "deposito bpu", *(p for p in COMMON_LATER if p != "payclip s de rl de cv")),
    ),
    "inbursa": LineRules(
        (), ("deposito spei",),
        ("operadora paypal de mexico s de rl", "payclip s de rl decv", "deposito bpu", *COMMON_LATER),
    ),
    "intercam": _RECEPTION,
    "vepormas": _RECEPTION,
}

# Phrases for a bank without rules of its own, on any line.
GENERIC_LINES = (
    "evopay", "evopayments", "psm payment services mexico sa de cv", "deposito bpu {10d}",
    "cobra online s.a.p.i. de c.v.", "sr. pago", "por favor paguen a tiempo, s.a. de c.v.",
    "por favor paguen a tiempo", "pagofácil", "netpay s.a.p.i. de c.v.", "netpay",
    "deremate.com de méxico, s. de r.l. de  c.v.", "mercadolibre s de rl de cv",
    "mercado lending, s.a de c.v", "first data merchant services méxico s. de r.l. de c.v",
    "adquira méxico, s.a. de c.v", "payclip, s. de r.l. de c.v",
    "pocket de latinoamérica, s.a.p.i de c.v.", "billpocket", "pocketgroup", "evo payments",
    "net pay sa de cv", "net pay sapi de cv", "izettle méxico, s. de r.l. de c.v.",
    "izettle mexico s de rl de cv", "pocket de latinoamerica sapi de cv", "bn-nts",
    "izettle mexico s de rl", "first data merc", "cobra online sapi de cv", "payclip s de rl de cv",
    "evopaymx", "izettle", "refbntc00017051", "pocket de", "sofimex", "actnet", "exce cca",
    "venta nal. amex",
)

# Words that carry over to the label as they are.
LABEL_WORDS = {
    "traspaso entre cuentas": "traspaso entre cuentas",
    "financiamiento": "financiamiento",
    "credito": "crédito",
}
