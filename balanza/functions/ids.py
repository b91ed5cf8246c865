"""Identity columns: tax ids, account numbers, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from balanza.rules import banks as B, certificates as C


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def account_keys(clabe: Column) -> Column:
    """An account number and, when it has 18 digits, its last 10 and last 11 digits."""
    number = digits(clabe)
    return (
        F.when(number == "", F.array().cast("array<string>"))
        .when(F.length(number) == 18, F.array(number, F.right(number, F.lit(10)), F.right(number, F.lit(11))))
        .otherwise(F.array(number))
    )


def normalize_clabe(clabe: Column, bank: Column) -> Column:
    """Digits only, left-padded to 18 except for American Express accounts."""
    number = F.nullif(digits(clabe), F.lit(""))
    amex = F.coalesce(F.lower(bank).contains("american"), F.lit(False))
    return F.when(amex | (F.length(number) >= 18), number).otherwise(F.lpad(number, 18, "0"))


def is_valid_account(rfc: Column, clabe: Column, bank: Column, text: Column, head: int | None = None) -> Column:
    """Quality gate of an account: never a bank's own id; a full account number passes at once.

    An investment statement is known by its text, or by its first ``head`` characters.
    """
    tax_id = F.upper(F.trim(F.coalesce(rfc, F.lit(""))))
    number = digits(clabe)
    low = F.lower(F.trim(F.coalesce(bank, F.lit(""))))
    amex = low.contains("american") | low.contains("amex")
    whole = F.coalesce(text, F.lit(""))
    start = F.lower(whole if head is None else F.left(whole, F.lit(head)))
    return (
        F.when(tax_id.isin(*B.BANK_TAX_IDS), F.lit(False))
        .when((F.length(number) >= 18) | (amex & (F.length(number) == 15)), F.lit(True))
        .when(start.contains("estado de cuenta de inversiones"), F.lit(False))
        .otherwise(tax_id.rlike(r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$"))
    )


def account_label(bank: Column, clabe: Column) -> Column:
    """``BANK-1234``, or the bank alone for a short account number."""
    number = F.coalesce(clabe, F.lit(""))
    return F.when(F.length(number) >= 4, F.concat(bank, F.lit("-"), F.right(number, F.lit(4)))).otherwise(bank)


def tax_ids(text: Column, doc_type: str) -> Column:
    """Upper-case tax ids in a KYC text, without those of institutions."""
    found = F.regexp_extract_all(text, F.lit(C.RFC_PATTERNS[doc_type]), F.lit(1))
    upper = F.transform(found, lambda v: F.upper(v))
    return F.filter(upper, lambda v: ~v.isin(*C.INSTITUTION_TAX_IDS))


def person_ids(text: Column) -> Column:
    """Upper-case personal ids in a KYC text."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.CURP_PATTERN), F.lit(1)), lambda v: F.upper(v))


def taxpayer_type(text: Column) -> Column:
    """Person, company or unknown, from the lower-cased certificate text."""
    return (
        F.when(text.contains("curp"), F.lit("persona_fisica"))
        .when(text.rlike(r"raz[oó]n social|r[ée]gimen capital"), F.lit("persona_moral"))
        .otherwise(F.lit("desconocido"))
    )


def identity_alert(rfc: Column, holder: Column) -> Column:
    """Which of tax id and name could not be found; NULL when both are there."""
    def blank(c):
        return F.coalesce(c, F.lit("")) == ""

    missing = F.concat_ws(" ni ", F.when(blank(rfc), F.lit("RFC")), F.when(blank(holder), F.lit("Nombre")))
    return F.when(
        missing != "",
        F.concat(F.lit("Extracción de identidad incompleta: No se pudo localizar "), missing, F.lit(".")),
    )
