"""Money columns. Sums stay decimal so that they do not depend on partitioning or row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MONEY_TOKEN = r"[+-]?\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}"


def amount_or_null(text: Column) -> Column:
    """``$1,234.50`` as a double; NULL when it is not a number."""
    clean = F.trim(F.translate(text, "$,", ""))
    return F.when(clean.rlike(_NUMBER), clean.try_cast("double"))


def clean_amount(text: Column) -> Column:
    """As :func:`amount_or_null`, with 0 for text that is not a number and for NULL."""
    return F.coalesce(amount_or_null(text), F.lit(0.0))


def sum_amounts(texts: Column) -> Column:
    """Sum of an array of money strings; items that are not numbers are passed over."""
    return F.aggregate(texts, F.lit(0.0), lambda acc, item: acc + _plain_number(item))


def _plain_number(text: Column) -> Column:
    clean = F.trim(F.translate(text, ",", ""))
    return F.coalesce(F.when(clean.rlike(_NUMBER), clean.try_cast("double")), F.lit(0.0))


def first_money(text: Column) -> Column:
    """The first money token in a text, 0 when there is none."""
    token = F.regexp_extract(text, MONEY_TOKEN, 0)
    return F.coalesce(F.regexp_replace(token, r"[$,\s]", "").try_cast("double"), F.lit(0.0))


def guarantee_amount(text: Column) -> Column:
    """Amount inside a guarantee note such as ``$ 12,345.67 Peso``."""
    token = F.regexp_extract(F.coalesce(text, F.lit("")), r"[\d,]+\.?\d*", 0)
    return F.coalesce(F.translate(token, ",", "").try_cast("double"), F.lit(0.0))


def guarantee_currency(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("dolar") | low.contains("usd"), F.lit("USD")).otherwise(F.lit("MXN"))


def bureau_amount(text: Column) -> Column:
    """Bureau amounts such as ``0001200+``; signs are removed, bad text is 0."""
    return F.coalesce(F.trim(F.translate(text, "+-", "")).try_cast("double"), F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """Division in doubles that gives 0 for a zero or NULL denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def fix_percent(value: Column) -> Column:
    """Shares written as 0-100 brought to 0-1."""
    return F.when(value > 1.0, value / F.lit(100.0)).otherwise(value)


def is_credit(kind: Column) -> Column:
    """Whether a movement type means money coming in."""
    return F.coalesce(F.lower(F.trim(kind)).isin(*CREDIT_WORDS), F.lit(False))


# Movement types that count as credits.
CREDIT_WORDS = ("abono", "deposito", "depósito", "credito", "crédito")
