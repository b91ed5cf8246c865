"""Card-terminal providers: aggregators seen at any bank, and each bank's own terms."""

from __future__ import annotations

# Provider name and its keywords, in search order.
AGGREGATORS = {
    "BILLPOCKET": (
        "billpocket", "deposito pocketgroup", "deposito billpocket", "deposito bpu", "pocketgroup",
        "pocket de latinoamerica sapi de cv", "pocket de latinoamérica, s.a.p.i de c.v.",
    ),
    "GETNET": ("getnet",),
    "FISERV": ("fiserv", "first data", "firstdata"),
    "SR PAGO": ("sr pago", "srpago"),
    "KIWI": ("kiwi", "kiwi bop sa de cv", "kiwi international payment technologies"),
    "CLIP": ("clip",),
    "MENTA": ("menta",),
    "ZETTLE": ("zettle", "izettle", "izettle by paypal", "zettle by pay pal", "zettle by paypal"),
    "MERCADO PAGO": ("mercado pago", "mercadopago"),
    "MP AGREGADOR": ("mp agregador", "blue point"),
    "NET PAY": ("net pay", "netpay"),
    "SMPS": ("smps",),
    "WUZI": ("wuzi",),
    "VELPAY": ("velpay",),
    "EVOPAY": (
        "evopay mx", "evopay", "deposito ventas netas por evopaymx", "deposito ventas netas d tar",
        "deposito ventas netas d amex",
    ),
}
BANK_TERMS = {
    "BANBAJIO": ("deposito negocios afiliados",),
    "BBVA": (
        "terminales punto de venta", "tdc inter", "ventas crédito", "ventas débito", "ventas nal. amex",
        "ventas nal amex",
    ),
    "AFIRME": ("venta tpv cr", "venta tpv db", "venta tpvcr", "venta tpvdb"),
    "HSBC": (
        "venta tpv hsbc", "ventatpv hsbc", "venta tpvhsbc", "venta tpv cr hsbc", "venta tpv db hsbc",
        "venta tpvcr hsbc", "venta tpvdb hsbc", "transf rec hsbcnet tpv cr",
        "transf rec hsbcnet tpv db", "transf rec hsbcnet tpvcr", "transf rec hsbcnet tpvdb",
    ),
    "MIFEL": (
        "venta tpv mifel", "ventatpv mifel", "venta tpvmifel", "venta tpv cr mifel",
        "venta tpv db mifel", "venta tpvcr mifel", "venta tpvdb mifel", "transf rec mifelnet tpv cr",
        "transf rec mifelnet tpv db", "transf rec mifelnet tpvcr", "transf rec mifelnet tpvdb",
        "vta. cre", "vta. deb", "vta cre", "vta deb",
    ),
    "SCOTIABANK": ("amexco se", "american express company mexico", "american express company"),
    "BANREGIO": ("abono ventas tdd", "abono ventas tdc", "abono ventastdd", "abono ventastdc"),
    "SANTANDER": ("deposito ventas del día afil", "deposito ventas del dia afil"),
    "MULTIVA": (
        "ventas tpvs", "ventas tdd", "ventas tdc", "ventas tarjetas", "ventas tdc inter", "venta credito",
        "ventas debito",
    ),
}
TERMINAL_NUMBER_BANK = "BANORTE"
TERMINAL_NUMBER_PATTERN = r"\b\d{8}[cd]\b"
TERMINAL_NUMBER_NAME = "BANORTE TERMINAL"
UNKNOWN_PROVIDER = "NO DEFINIDA"
