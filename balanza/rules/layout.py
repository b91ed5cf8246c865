"""Layout rules: header words, triggers, column names, noise."""

from __future__ import annotations

# Points of header words.
HEADER_SCORES = {
    "FECHA": 1, "DATE": 1, "DIA": 1, "DÍA": 1, "FECHAS": 1,
    "DESCRIPCIÓN": 1, "CONCEPTO": 1, "DESCRIPCION": 1, "DETALLE": 1, "REFERENCIA": 1,
    "CARGO": 2, "RETIRO": 2, "DEBITO": 2, "RETIROS": 2, "SALIDAS": 2,
    "DEPÓSITOS": 2, "DEPOSITOS": 2, "ENTRADAS": 2, "ABONO": 2, "DEPOSITO": 2, "CREDITO": 2, "DEPÓSITO": 2,
    "SALDO": 2, "BALANCE": 2, "SUCURSAL": 1, "OFICINA": 1,
    "IMPORTE": 2, "BENEFICIARIO": 2, "RASTREO": 2, "CLAVE": 1, "RECEPTOR": 2, "MOTIVO": 1, "VALOR": 1, "MONTO": 2,
}
# Words that rule a line out as a header, and the exception.
HEADER_DENYLIST = (
    "PROMEDIO", "ANTERIOR", "TOTAL", "GRAVABLE", "ISR", "COMISIONES", "GAT", "PERIODO", "TASA", "PENDIENTE", "LIQUIDAR",
    "SALDO INICIAL", "SPEI", "RECUPERACION", "SUMA", "CORTE", "LATINOAMERICA", "NOMINAL", "SEGURIDAD", "IMPUESTOS",
    "OBJETADOS", "TARJETA", "TERCERO", "VENTAS", "TRASPASOS", "SALDO ANTERIOR", "(+)",
)
HEADER_EXCEPTION = ("TOTAL", "SALDO TOTAL")

# Texts below the table, and texts that end the reading of a document.
FOOTER_TRIGGERS = (
    r"este\s+documento\s+es\s+una\s+representaci[oó]n", r"total\s+de\s+movimientos", r"saldo\s+final", r"timbres?\s+fiscal",
    r"folio\s+fiscal", r"cargos?\s+objetados?\s+por\s+el\s+cliente", r"unidad\s+especializada\s+de\s+atenci[oó]n",
    r"informaci[oó]n\s+fiscal", r"detalles?\s+de\s+movimientos\s+dinero\s+creciente", r"inversi[oó]n\s+creciente",
    r"saldo\s+final\s+del\s+periodo", r"detalles\s+del\s+cr[eé]dito", r"spei\s+enviados",
    r"comisiones\s+pendientes\s+de\s+pago", r"^\s*fondo[s]?\s+de\s+inversi[oó]n\s*\*?",
    r"su\s+estado\s+de\s+cuenta\s+ha\s+sido\s+modificado",
)
HARD_STOP_TRIGGERS = (
    r"inversiones\s+premier\s+bajio", r"inversiones\s+a\s+plazo\s+fijo", r"mercado\s+de\s+dinero", r"sociedades\s+de\s+inversi[oó]n",
    r"operaciones\s+vigentes", r"detalle\s+de\s+vencimientos", r"apartados\s+vigentes", r"^\[\s*saldo\s+inicial\s+de",
    r"resumen\s*fiscal\s*de\s*cr[eé]dito", r"^\s*fondo[s]?\s+de\s+inversi[oó]n\s*\*?",
)

# Words that name each column.
COLUMN_WORDS = {
    "FECHA": ("FECHA", "DIA", "DÍA", "DATE"),
    "DESCRIPCION": ("DESCRIPCION", "DESCRIPCIÓN", "CONCEPTO", "DETALLE", "NARRATIVA", "OPERACIONES"),
    "REFERENCIA": ("REFERENCIA", "FOLIO", "DOCTO"),
    "CARGO": ("CARGO", "CARGOS", "RETIRO", "RETIROS", "DEBITO", "SALIDAS"),
    "ABONO": ("ABONO", "ABONOS", "DEPOSITO", "DEPÓSITO", "DEPOSITOS", "DEPÓSITOS", "CREDITO", "ENTRADAS"),
    "SALDO": ("SALDO", "BALANCE"),
    "IMPORTE": ("IMPORTE", "VALOR", "UNIFICADO", "MONTO"),
}
# The two profiles for headers found further down a page.
BAND_PROFILES = (
    (15.5, {
        "FECHA": ("FECHA", "DIA", "DATE"),
        "DESCRIPCION": ("DESCRIPCION", "DESCRIPCIÓN", "CONCEPTO", "DETALLE", "NARRATIVA"),
        "REFERENCIA": ("REFERENCIA", "FOLIO", "DOCTO", "AUTORIZACION"),
        "CARGO": ("CARGO", "RETIRO", "DEBITO", "SALIDAS"),
        "ABONO": ("ABONO", "ABONOS", "DEPOSITO", "DEPÓSITO", "DEPOSITOS", "DEPÓSITOS", "CREDITO", "ENTRADAS"),
        "SALDO": ("SALDO",),
        "IMPORTE": ("IMPORTE", "VALOR", "MONTO"),
    }),
    (30.0, {
        "FECHA": ("FECHA",), "CARGO": ("CARGO", "RETIRO"), "IMPORTE": ("IMPORTE", "MONTO"),
        "DESCRIPCION": ("CONCEPTO", "MOTIVO", "BENEFICIARIO"),
        "REFERENCIA": ("RASTREO", "CLAVE", "REFERENCIA", "AUTORIZACION"),
        "EXTRA": ("RECEPTOR", "NOMBRE", "TARJETA", "CUENTA"),
    }),
)
BAND_MIN_MATCHES = 4
# How lines further down a page are tried as headers (score, line height, distances).
BAND_SCORE, BAND_LINE = 2, 5
BAND_APART, BAND_REACH = 30.0, 600.0
BAND_TRY_UP, BAND_UP, BAND_TOP = 15.0, 5.0, 10.0

# Date shapes, money shape, words that are no dates, texts that are no description.
MONTHS_RX = "(?:ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|OCT|NOV|DIC|JAN|APR|AUG|DEC)"
DATE_TEXT_RX = r"(?i)^\d{1,2}\s*[-/]?\s*" + MONTHS_RX
DATE_NUMBER_RX = r"^\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?"
MONEY_RX = r"[-+]?\s*\d{1,3}(?:,\d{3})*\.\d{2}"
DATE_NOISE = ("SUC", "HORA", "CAJA", "AUT", "REF", "SEC", "MOV")
IGNORED_TEXT = ("SALDO ANTERIOR", "TOTAL", "TRASPASO ENTRE CUENTAS", "SALDO FINAL", "NUEVOS CARGOS Y ABONOS")
TOTAL_LINES = ("TOTAL", "SUBTOTAL", "SUMA", "SALDO FINAL", "TOTALES")
TOTAL_ROW_RX = (
    r"(?i)^\s*(TOTAL|SUMA|GRAN\s+TOTAL|SALDO\s+M[IÍ]NIMO|COMISIONES\s+COBRADAS|Y\s+DEP[ÓO]SITOS|NOMINAL3\s+GAT|EN\s+EL\s+AÑO\s+DEL\s+PERIODO)"
    r"|(?:\n|\s{3,})\s*(TOTAL|SUMA|GRAN\s+TOTAL)\s*$"
)
TOTAL_ROW_TEXT = ("TOTAL DE LAS", "MOVIMIENTOS DEL PRESENTE ESTADO", "SALDO INICIAL")
JUNK_LINE_RX = r"^(\$|\d{4,6})$"

# Distances in points.
HEADER_SCAN_UP, HEADER_TOLERANCE, MIN_NEW_HEADER = 30.0, 40.0, 3
SEARCH_FIRST, SEARCH_LATER, FALLBACK_HEADER = 0.90, 0.60, 0.20
ROW_GAP, LINE_GAP, TEXT_MARGIN = 6.0, 5.0, 25.0
MONEY_UP, MONEY_DOWN = 25.0, 20.0

# Zones of a page that list transfers or credit parts.
ZONE_TRIGGERS = (
    ("RECIBIDOS", ("SPEI RECIBIDOS", "DETALLE DE MOVIMIENTOS SPEI", "SPEI RECIBIDO")),
    ("ENVIADOS", ("SPEI ENVIADOS", "SPEI ENVIADO")),
    ("DETALLE_CREDITO", ("DETALLES DEL CRÉDITO", "DETALLE DEL CRÉDITO")),
)

# Fixed value: blocks of a scanned row that may hold its date.
DATED_BLOCKS = 3

# Lines of a scanned statement to pass over, and lane positions used by default.
SCAN_JUNK = (
    "ESTE DOCUMENTO ES UNA REPRESENTACIÓN", "SELLO DIGITAL", "CADENA ORIGINAL", "IPAB", "FONDOS DE INVERSION", "SUMA DE RETIROS",
    "DETALLES DEL CRÉDITO", "SALDO A FECHA DE CORTE", "COMPROBANTE FISCAL", "FOLIO FISCAL", "BANCA MIFEL, S.A",
    "WWW.MIFEL.COM.MX", "RÉGIMEN FISCAL", "ESTADO DE CUENTA", "CUENTA A LA VISTA", "PÁGINA", "PAGINA", "RFC:", "PROTECCIÓN PARA LA",
    "INSTITUTO AL AHORRO", "REFERENCIA DE ABREVIATURAS", "MENSAJES IMPORTANTES", "ACLARACIONES", "CONDUSEF", "INFORMACION IMPORTANTE",
)
DEFAULT_LANES = {"retiro": 0.595, "deposito": 0.710, "saldo": 0.825}
LANE_GAP, LANE_MARGIN, LANE_MIN_SAMPLES = 0.04, 0.08, 10
OPENING_RX = r"(?i)SALDO\s+INICIAL.*?(\d{1,3}(?:,\d{3})*\.\d{2})"
