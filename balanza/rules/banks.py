"""Bank configuration: aliases and statement patterns, plus account ids that are never a customer's."""

from __future__ import annotations

_ID_LOW = r"([a-zñ&]{3,4}\d{6}[a-z0-9]{2,3})"
_ID_ANY = r"([a-zA-ZÑ&]{3,4}\d{6}[a-zA-Z0-9]{2,3})"
_AMOUNT = r"([\d,]+\.\d{2})"

# Per bank the aliases and the patterns of tax id, charged fees and deposits.
BANKS = {
    "banorte": {
        "alias": ["banco mercantil del norte"],
        "rfc": [r"rfc:\s*" + _ID_LOW],
        "comisiones": [r"total de comisiones cobradas / pagadas\s*\$\s*" + _AMOUNT],
        "depositos": [r"total de depósitos\s*\$\s*" + _AMOUNT],
    },
    "banbajío": {
        "alias": ["banco del bajio", "banco del bajío"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_LOW],
        "comisiones": [r"comisiones efectivamente cobradas\s*\$\s*" + _AMOUNT],
        "depositos": [
            r"saldo anterior \(\+\) depositos \(\-\) cargos saldo actual\s*\n\$\s*[\d,.]+\s+\$\s*" + _AMOUNT
        ],
    },
    "afirme": {
        "alias": ["banca afirme"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_LOW],
        "comisiones": [r"total de comisiones\s*\$\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos\s+\$\s*" + _AMOUNT],
    },
    "hsbc": {
        "alias": ["grupo financiero hsbc"],
        "rfc": [r"rfc[^\n]*\n\s*" + _ID_LOW],
        "comisiones": [r"comisiones cobradas(?: en el mes)? \$" + _AMOUNT],
        "depositos": [r"dep[éeóo]sitos/? \$ " + _AMOUNT],
    },
    "mifel": {
        "alias": ["grupo financiero mifel"],
        "rfc": [r"rfc\s*" + _ID_LOW],
        "comisiones": [r"comisiones efectivamente cobradas\s+" + _AMOUNT],
        "depositos": [r"[0-9]\.\s*dep[óo]sitos\s+\$?([\d,]+(?:\.\d{2})?)"],
    },
    "scotiabank": {
        "alias": ["scotiabank inverlat"],
        "rfc": [r"r\.*\s*f\.*\s*c\.*\s*cliente\s*" + _ID_ANY],
        "comisiones": [r"comisiones\s*cobradas\s*\$" + _AMOUNT],
        "depositos": [r"\(\+\)\s*dep[óo]sitos\s*\$" + _AMOUNT],
    },
    "banregio": {
        "alias": ["banco regional"],
        "rfc": [r"rfc:\s*" + _ID_LOW],
        "comisiones": [r"comisiones efectivamente cobradas\s*\$" + _AMOUNT],
        "depositos": [r"(?:\+?\s*abonos)\s*\$" + _AMOUNT],
    },
    "bbva": {
        "alias": ["grupo financiero bbva"],
        "rfc": [r"r\.f\.c\s*" + _ID_LOW],
        "comisiones": [r"total comisiones\s+" + _AMOUNT],
        "depositos": [r"dep[óo]sitos\s*/\s*abonos\s*\(\+\)\s*\d+\s+" + _AMOUNT],
    },
    "multiva": {
        "alias": ["banco multiva"],
        "rfc": [r"rfc\s*" + _ID_LOW],
        "comisiones": [r"comisiones cobradas\/bonificaciones\s+" + _AMOUNT],
        "depositos": [r"retiros\/depósitos\s+[\d,]+\.\d{2}\s+" + _AMOUNT],
    },
    "santander": {
        "alias": ["banco santander", "bancosantander"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_LOW],
        "comisiones": [r"comisiones cobradas\s*.+?\s*" + _AMOUNT],
        "depositos": [r"(?:dep.{0,10}sitos)\s*\$?" + _AMOUNT],
    },
    "banamex": {
        "alias": ["banco nacional de mexico", "banco nacional de méxico", "domiciliación banamex"],
        "rfc": [r"rfc\s*" + _ID_LOW, r"registro federal de contribuyentes:\s*" + _ID_LOW],
        "comisiones": [r"comisiones efectivamente cobradas\s*\$\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos\s*" + _AMOUNT],
    },
    "citibanamex": {
        "alias": ["citibanamex"],
        "rfc": [r"rfc\s*" + _ID_LOW, r"registro federal de contribuyentes:\s*" + _ID_LOW],
        "comisiones": [r"comisiones efectivamente cobradas\s*\$\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos\s*" + _AMOUNT],
    },
    "bancrea": {
        "alias": ["banco bancrea"],
        "rfc": [r"rfc:\s+" + _ID_ANY],
        "comisiones": [r"comisiones cobradas en el per[ií]odo\s+" + _AMOUNT],
        "depositos": [r"dep[oó]sitos\s*" + _AMOUNT],
    },
    "inbursa": {
        "alias": ["banco inbursa"],
        "rfc": [r"rfc:\s+" + _ID_ANY],
        "comisiones": [r"en el periodo\s*" + _AMOUNT],
        "depositos": [r"abonos\s*" + _AMOUNT],
    },
    "monex": {
        "alias": ["banco monex"],
        "rfc": [r"rfc titular:\s+" + _ID_ANY],
        "comisiones": [r"comisiones\s+" + _AMOUNT],
        "depositos": [r"total abonos:\s*" + _AMOUNT],
    },
    "azteca": {
        "alias": ["banco azteca"],
        "rfc": [r"rfc:\s+" + _ID_ANY],
        "comisiones": [r"comisiones[\s\S]*?\$\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos[\s\S]*?\$\s*" + _AMOUNT],
    },
    "bankaool": {
        "alias": ["bankaool"],
        "rfc": [r"rfc\s+" + _ID_ANY],
        "comisiones": [r"comisiones cobradas[\s\S]*?\$\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos[\s\S]*?\$\s*" + _AMOUNT],
    },
    "intercam": {
        "alias": ["intercuenta enlace intercam"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_ANY],
        "comisiones": [r"comisiones efectivamente\s*" + _AMOUNT],
        "depositos": [r"dep[éeóo]sitos\s*" + _AMOUNT],
    },
    "vepormas": {
        "alias": ["grupo financiero ve por más", "grupo financiero ve por mas"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_ANY],
        "comisiones": [r"r\.f\.c\.\s*" + _ID_ANY],
        "depositos": [r"dep[oó]sitos\s*" + _AMOUNT],
    },
    "mercado libre": {
        "alias": ["mercado libre", "mercadolibre"],
        "rfc": [r"r\.f\.c\.\s*" + _ID_ANY],
        "comisiones": [r"comisiones\s*" + _AMOUNT],
        "depositos": [r"dep[oó]sitos\s*" + _AMOUNT],
    },
    "kapital": {
        "alias": ["kapital", "kapital mexico grupo financiero"],
        "rfc": [r"rfc\s*" + _ID_LOW],
        "comisiones": [r"comisiones\s*cobradas\s*\$\s*" + _AMOUNT],
        "depositos": [],
    },
}

# Addends of one bank's declared deposits and charges, with their patterns.
KAPITAL_DEPOSITS = {
    "dep_efectivo": r"dep[oó]sitos en efectivo\s*\$?\s*" + _AMOUNT,
    "dep_cheques": r"dep[oó]sitos de cheques\s*\$?\s*" + _AMOUNT,
    "transf_recibidas": r"transferencia recibida\s*\$?\s*" + _AMOUNT,
    "otros_abonos": r"otros abonos a su cuenta\s*\$?\s*" + _AMOUNT,
    "intereses_ganados": r"intereses ganados\s*\$?\s*" + _AMOUNT,
    "movimientos_mes_abonos": r"\(\s*\+\s*\)\s*movimientos del mes\s*\$?\s*" + _AMOUNT,
}
KAPITAL_CHARGES = {
    "ret_efectivo": r"retiros efectivo sucursal y cajeros autom[aá]ticos\s*\$?\s*" + _AMOUNT,
    "cheques_cobrados": r"cheques cobrados\s*\$?\s*" + _AMOUNT,
    "transf_enviadas": r"transferencias enviadas\s*\$?\s*" + _AMOUNT,
    "otros_cargos": r"otros cargos a sus cuentas\s*\$?\s*" + _AMOUNT,
    "ret_isr": r"retenciones de isr\s*\$?\s*" + _AMOUNT,
    "int_prestamos": r"intereses por pr[eé]stamos otorgados\s*\$?\s*" + _AMOUNT,
    "amort_prestamos": r"amortizaci[oó]n por pr[eé]stamos otorgados\s*\$?\s*" + _AMOUNT,
    "movimientos_mes_cargos": r"\(\s*[\-\–\—]\s*\)\s*movimientos del mes\s*\$?\s*" + _AMOUNT,
}

# Tax ids of banks, never of an account holder.
BANK_TAX_IDS = ("BBA830831LJ2", "BNM840515VB1", "BBA940707IE1", "BMB930211WA9", "BAI0205236Y8")

# Words that show a text is a statement.
STATEMENT_WORDS = ("banco", "banca", "cliente", "estado de cuenta", "rfc", "periodo")

# Where an account starts and ends inside a document.
START_TRIGGERS = (
    'la gat real es el rendimiento que obtendría después de descontar la inflación estimada"',
    "detalle de la cuenta",
    "detalle de movimientos realizados",
)
END_TRIGGERS = ("este documento es una representación impresa de un cfdi", "total de movimientos")

# Screening vetoes, bank names in file names.
VETO_TEXT = (
    "constancia de situación fiscal", "cédula de identificación fiscal", "comprobante fiscal digital",
    "recibo de nómina", "comisión federal de electricidad",
)
VETO_NAME = ("csf", "nomi", "factura", "recibo")
NAME_HINTS = (
    "hsbc", "banamex", "bbva", "banorte", "santander", "scotiabank", "bajio", "inbursa", "regio",
    "azteca", "edo", "cta",
)
