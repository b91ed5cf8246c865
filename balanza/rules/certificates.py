"""Tax certificate and KYC patterns."""

from __future__ import annotations

_DAY_TEXT = r"([0-9]{1,2}\s+de\s+[a-z]+\s+de\s+[0-9]{4})"

# Single-value patterns of the certificate, common to both taxpayer types.
COMMON_FIELDS = {
    "rfc": r"(?i)rfc:\s+([a-z0-9]{12,13})",
    "inicio_operaciones": r"(?i)fecha inicio de operaciones:\s+" + _DAY_TEXT,
    "estatus_padron": r"(?i)estatus en el padrón:\s+([a-z]+)",
    "cambio_estado": r"(?i)fecha de último cambio de estado:\s+" + _DAY_TEXT,
    "codigo_postal": r"(?i)c[oó]digo postal:\s*(\d{5})",
    "nombre_vialidad": r"(?i)nombre de vialidad:\s+([a-z\s]+)n[uú]mero",
    "numero_interior": r"(?i)n[uú]mero interior:\s+([a-z\s]+)nombre",
    "nombre_localidad": r"(?i)nombre de la localidad:\s+([a-z\s]+)nombre",
    "entidad_federativa": r"(?i)nombre de la entidad federativa:\s+([a-z\s]+)entre",
    "vialidad": r"(?i)tipo de vialidad:\s*([^\n]+)",
    "numero_exterior": r"(?i)n[uú]mero exterior:\s*([^\n]+)",
    "colonia": r"(?i)nombre de la colonia:\s*([^\n]+)",
    "municipio": r"(?i)nombre del municipio o demarcaci[oó]n territorial:\s*([^\n]+)",
    "calle": r"(?i)entre calle:\s*([^\n]+)",
}
PERSON_FIELDS = {
    "curp": r"(?i)curp:\s+([a-z0-9]{18})",
    "nombre": r"(?i)nombre \(s\):\s+([^\n]+)\n",
    "primer_apellido": r"(?i)primer apellido:\s+([a-z\s]+)\n",
    "segundo_apellido": r"(?i)segundo apellido:\s+([a-z\s]+)\n",
    "nombre_comercial": r"(?i)nombre comercial:\s*(.*?)(?:\s*datos|\n|$)",
}
COMPANY_FIELDS = {
    "razon_social": r"(?i)raz[oó]n social:\s+([^\n]+)",
    "regimen_capital": r"(?i)r[eé]gimen capital:\s+([a-z\s]+)\n",
    "nombre_comercial": r"(?i)nombre comercial:\s*(.*?)(?:\s*fecha|\n|$)",
}
ACTIVITY_PATTERN = (
    r"(?im)^\s*(\d+)\s+(.+?)\s+(\d{1,3})\s+(\d{2}/\d{2}/\d{4})(?:\s+(\d{2}/\d{2}/\d{4}))?"
)
ACTIVITY_TAIL = r"((?:\n(?!\s*\d).+)*)"
REGIME_PATTERN_PERSON = r"(?im)^\s*(r[eé]gimen[^\n]+?)\s+(\d{2}/\d{2}/\d{4})(?:\s+(\d{2}/\d{2}/\d{4}))?"
REGIME_PATTERN_COMPANY = r"(?im)(r[eé]gimen.+?)\s+(\d{2}/\d{2}/\d{4})(?:\s+(\d{2}/\d{2}/\d{4}))?"

# Placeholders written in place of a neighbourhood.
EMPTY_NEIGHBOURHOODS = (
    "otra no especificada en el catálogo", "otra no especificada en el catalogo", "no aplica", "n/a",
)

# Identity patterns per KYC document type, and ids of institutions to pass over.
_TAX_ID = r"([a-zñ&]{3,4}\d{6}[a-z0-9]{3})"
RFC_PATTERNS = {
    "nomina": r"r\.?f\.?c\.?\s+" + _TAX_ID,
    "estado": r"r\.?f\.?c\.?:?\s+" + _TAX_ID,
}
CURP_PATTERN = r"curp:\s*([a-z]{4}\d{6}[hm][a-z]{5}\d{2})"
INSTITUTION_TAX_IDS = (
    "BBA830831LJ2", "BNM840515VB1", "BSM970519DU8", "HMI950125KG8", "BMN930209927", "SIN9412025I4",
    "CBA131211E64",
)
