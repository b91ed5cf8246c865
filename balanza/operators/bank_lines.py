"""Card-sale labels from the lines of a movement text, per bank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.money import is_credit
from balanza.rules.bank_lines import BANK_LINES, GENERIC_LINES, LABEL_WORDS, LineRules


def phrase_pattern(phrases) -> str:
    """One alternation for phrases; ``{6d}`` is six digits, ``{n}`` a number, ``{name}`` a word."""
    out = []
    for phrase in phrases:
        text = re.escape(phrase).replace(r"\ ", " ").replace(r"\{", "{").replace(r"\}", "}")
        text = re.sub(r"\{(\d+)d\}", r"\\d{\1}", text).replace("{n}", r"\d+").replace("{name}", r"\S+")
        out.append(text)
    return "|".join(out)


def bank_line_labels(
    df: DataFrame, banks: dict[str, LineRules] | None = None, generic=GENERIC_LINES,
    bank: str = "bank", text: str = "description", kind: str = "kind",
) -> DataFrame:
    """Adds ``label``: tpv, a carried-over word, or general. Only money coming in gets one."""
    rules = BANK_LINES if banks is None else banks
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    lines = F.split(F.col("_low"), "\n")
    first = F.get(lines, F.lit(0))
    later = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    key = F.lower(F.trim(F.coalesce(F.col(bank), F.lit(""))))

    def hit(rule: LineRules) -> Column:
        out = F.lit(False)
        if rule.one_line:
            out = F.col("_low").rlike(phrase_pattern(rule.one_line))
        if rule.first_line and rule.later_lines:
            later_rx = phrase_pattern(rule.later_lines)
            out = out | (first.rlike(phrase_pattern(rule.first_line)) & F.exists(later, lambda line: line.rlike(later_rx)))
        return out

    # One branch per bank, so a row only tries the phrases of its own bank.
    sale = None
    for name, rule in rules.items():
        sale = F.when(key == name, hit(rule)) if sale is None else sale.when(key == name, hit(rule))
    other = F.col("_low").rlike(phrase_pattern(generic))
    sale = other if sale is None else sale.otherwise(other)
    label = F.when(~is_credit(F.col(kind)), F.lit("general"))
    for word, name in LABEL_WORDS.items():
        label = label.when(F.col("_low").contains(word), F.lit(name))
    return df.withColumn("_low", low).withColumn("label", label.when(sale, F.lit("tpv")).otherwise(F.lit("general"))).drop("_low")


def terminal_provider(bank: Column, text: Column, rules=None) -> Column:
    """Provider of a card-terminal deposit: terminal numbers, aggregators, then the bank's own terms.

    ``text`` is folded without punctuation, as are the keywords.
    """
    from balanza.functions.text import fold_literal, keyword_hit
    from balanza.rules import providers as P

    rules = rules or P

    def flat(words):
        return [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", fold_literal(w.lower()))).strip() for w in words]

    name = F.upper(F.trim(bank))
    out = F.when((name == rules.TERMINAL_NUMBER_BANK) & text.rlike(rules.TERMINAL_NUMBER_PATTERN), F.lit(rules.TERMINAL_NUMBER_NAME))
    for provider, words in rules.AGGREGATORS.items():
        out = out.when(keyword_hit(text, flat(words)), F.lit(provider))
    for own, words in rules.BANK_TERMS.items():
        out = out.when((name == own) & keyword_hit(text, flat(words)), F.lit(own))
    return out.otherwise(F.lit(rules.UNKNOWN_PROVIDER))
