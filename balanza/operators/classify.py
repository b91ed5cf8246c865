"""Movement classification: multi-tag, conflict rules, outside labels, fee subtypes, junk filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.money import is_credit
from balanza.functions.plan import settle
from balanza.functions.text import fold_literal, fold_text, keyword_hit
from balanza.operators.ordered import attach_group, position
from balanza.rules import tags as R


def _with_flags(df: DataFrame, rules, text: str, fold_rules: bool) -> DataFrame:
    """One boolean column ``_has_<tag>`` per rule, from a text that is folded once."""
    folded = df.withColumn("_text", fold_text(F.col(text)))
    flags = {}
    for rule in rules:
        words = tuple(fold_literal(k) for k in rule.keywords) if fold_rules else rule.keywords
        hit = keyword_hit(F.col("_text"), words)
        if rule.tag == "PAGO_FINANCIAMIENTO":
            hit = hit | F.col("_text").rlike(R.LOAN_PAYMENT_PATTERN)
        flags[f"_has_{rule.tag}"] = hit
    return folded.withColumns(flags).drop("_text")


def tag_movements(df: DataFrame, rules=R.TAG_RULES, text: str = "description", fold_rules: bool = False) -> DataFrame:
    """Adds ``tags``: array of struct(tag, weight) in rule order.

    Keywords with accents cannot occur in the folded text and so never hit; ``fold_rules`` folds
    the keywords too.
    """
    tags = F.array_compact(
        F.array(*[
            F.when(F.col(f"_has_{r.tag}"), F.struct(F.lit(r.tag).alias("tag"), F.lit(r.weight).alias("weight")))
            for r in rules
        ])
    )
    flagged = _with_flags(df, rules, text, fold_rules)
    return flagged.withColumn("tags", tags).drop(*[f"_has_{r.tag}" for r in rules])


def resolve_tags(df: DataFrame, rules=R.TAG_RULES, kind: str = "kind") -> DataFrame:
    """Adds ``category`` and ``reason`` from ``tags``; both NULL where no tag is left to decide."""
    names = F.transform("tags", lambda t: t["tag"])
    flags = df.withColumns({f"_has_{r.tag}": F.array_contains(names, r.tag) for r in rules})
    return _decide(flags, rules, kind).drop(*[f"_has_{r.tag}" for r in rules])


def decide_movements(
    df: DataFrame, rules=R.TAG_RULES, kind: str = "kind", text: str = "description", fold_rules: bool = False
) -> DataFrame:
    """Tagging and resolving in one step, without the ``tags`` array."""
    return _decide(_with_flags(df, rules, text, fold_rules), rules, kind).drop(*[f"_has_{r.tag}" for r in rules])


def _decide(flags: DataFrame, rules, kind: str) -> DataFrame:
    """The conflict rules as one ordered CASE over the tag flags.

    Money coming in is never a fee or VAT. Money going out is a loan payment before anything else,
    and loses fee and VAT tags when it is a transfer or a marketplace payout. Then VAT beats fees,
    fees beat exclusion, exclusion beats card sales, and the heaviest tag decides the rest.
    """
    weight = {r.tag: r.weight for r in rules}
    has = {r.tag: F.col(f"_has_{r.tag}") for r in rules}
    none = F.lit(False)
    junk = F.coalesce(F.lower(F.trim(F.col(kind))) == R.JUNK_KIND, none)
    state = flags.withColumns({
        "_in": is_credit(F.col(kind)),
        "_junk": junk,
        "_moved": has.get("TRASPASO", none) | has.get("BMRCASH", none),
    })
    incoming = F.col("_in")
    chargeable = ~incoming & ~F.col("_moved")

    steps = [(F.col("_junk"), F.lit(R.JUNK_CATEGORY), R.REASON_JUNK)]
    if "PAGO_FINANCIAMIENTO" in has:
        steps.append((~incoming & has["PAGO_FINANCIAMIENTO"], F.lit("PAGO_FINANCIAMIENTO"), R.REASON_LOAN_PAYMENT))
    if "IVA" in has:
        steps.append((chargeable & has["IVA"], F.lit("IVA"), R.REASON_IVA))
    for tag in sorted((t for t in R.FEE_TAGS if t in weight), key=lambda t: -weight[t]):
        steps.append((chargeable & has[tag], F.lit(tag), R.REASON_FEE.format(tag=tag)))
    if "EXCLUIDA" in has:
        steps.append((has["EXCLUIDA"], F.lit("GENERAL"), R.REASON_EXCLUDED))
    if "TPV" in has:
        steps.append((has["TPV"], F.lit("TPV"), R.REASON_TPV))
    by_sign = {
        "TRASPASO": ("TRASPASO_ABONO", "TRASPASO_CARGO"),
        "FINANCIAMIENTO": ("FINANCIAMIENTO", "PAGO_FINANCIAMIENTO"),
    }
    settled = (*R.FEE_TAGS, "IVA", "EXCLUIDA", "TPV")
    for rule in sorted((r for r in rules if r.tag not in settled), key=lambda r: -r.weight):
        plus, minus = by_sign.get(rule.tag, (rule.tag, rule.tag))
        steps.append((
            has[rule.tag], F.when(incoming, F.lit(plus)).otherwise(F.lit(minus)),
            R.REASON_WEIGHT.format(tag=rule.tag, weight=rule.weight),
        ))
    category = reason = None
    for condition, name, why in steps:
        category = F.when(condition, name) if category is None else category.when(condition, name)
        reason = F.when(condition, F.lit(why)) if reason is None else reason.when(condition, F.lit(why))
    return settle(state, {"category": category, "reason": reason}).drop("_in", "_junk", "_moved")


def classify(df: DataFrame, rules=R.TAG_RULES, kind: str = "kind") -> DataFrame:
    """Decides every movement; rows without a decision are GENERAL until labels arrive."""
    decided = decide_movements(df, rules, kind)
    return decided.withColumns({
        "pending": F.col("category").isNull(),
        "category": F.coalesce("category", F.lit("GENERAL")),
        "reason": F.coalesce("reason", F.lit(R.REASON_NO_LABEL)),
    })


def merge_labels(df: DataFrame, labels: DataFrame, on, kind: str = "kind", label: str = "label", order: str | None = None) -> DataFrame:
    """Outside labels onto rows without a category; rows without a label become GENERAL.

    ``labels`` has the key columns and ``label``. A key that comes more than once gives no row twice: the label
    that is last by the column ``order`` counts, or without one the first of them in the alphabet; empty ones don't.
    """
    keys = [on] if isinstance(on, str) else list(on)
    text = F.nullif(F.lower(F.trim(F.col(label))), F.lit(""))
    counts = F.min(text) if order is None else F.max_by(text, F.when(text.isNotNull(), F.col(order)))
    side = labels.groupBy(*keys).agg(counts.alias("_label"))
    credit = is_credit(F.col(kind))
    translated = (
        F.when(F.col("_label") == "traspaso entre cuentas",
               F.when(credit, F.lit("TRASPASO_ABONO")).otherwise(F.lit("TRASPASO_CARGO")))
        .when(F.col("_label") == "financiamiento",
              F.when(credit, F.lit("FINANCIAMIENTO")).otherwise(F.lit("PAGO_FINANCIAMIENTO")))
        .otherwise(F.upper("_label"))
    )
    open_row = F.col("category").isNull()
    return (
        df.join(side, keys, "left")
        .withColumns({
            "reason": F.when(~open_row, F.col("reason"))
            .when(F.col("_label").isNotNull(), F.lit(R.REASON_LABEL))
            .otherwise(F.lit(R.REASON_NO_LABEL)),
            "category": F.when(~open_row, F.col("category")).otherwise(F.coalesce(translated, F.lit("GENERAL"))),
        })
        .drop("_label")
    )


def assign_batches(df: DataFrame, doc: str, order, block: Column, max_size: int = 100) -> DataFrame:
    """Batch number per document, batches as even as possible and at most ``max_size`` long."""
    counts = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.select(
        doc, "_n", F.ceil(F.col("_n") / F.ceil(F.col("_n") / F.lit(max_size))).alias("batch_size")
    )
    placed = position(df, [doc], order, block, "_pos")
    return (
        attach_group(placed, sizes, [doc])
        .withColumn("batch", F.floor((F.col("_pos") - 1) / F.col("batch_size")).cast("bigint"))
        .drop("_pos")
    )


def fee_subtype(category: Column, text: Column) -> Column:
    """Card type of a fee still marked pending; other categories stay."""
    plain = fold_text(text)
    subtype = (
        F.when(plain.rlike(r"\b(cr|cre|credito)\b"), F.lit("COMISION_CR"))
        .when(plain.rlike(r"\b(db|deb|debito)\b"), F.lit("COMISION_DB"))
        .when(plain.rlike(r"\b(amex|american express|amexco)\b"), F.lit("COMISION_AMEX"))
        .otherwise(F.lit("COMISION_TPV_MIXTA"))
    )
    return F.when(category == "COMISION_PENDIENTE", subtype).otherwise(category)


def drop_junk(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Without rows read from invoices and stamps by mistake."""
    keep = ~F.coalesce(F.lower(F.trim(F.col(kind))) == R.JUNK_KIND, F.lit(False))
    if "category" in df.columns:
        keep = keep & (F.upper(F.trim(F.coalesce("category", F.lit("GENERAL")))) != R.JUNK_CATEGORY)
    return df.filter(keep)


def by_category(df: DataFrame, categories) -> DataFrame:
    return df.filter(F.upper(F.trim("category")).isin(*categories))
