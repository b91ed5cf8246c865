"""Duplicate statements, and fragment rows matched to their parent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from balanza.functions.ids import digits
from balanza.operators.ordered import attach_group
from balanza.session import cut

# Words that say nothing about a movement, and the shortest word that counts.
IGNORED_WORDS = (
    "de", "la", "el", "en", "por", "para", "un", "una", "spei", "pago", "envio", "transferencia", "cv", "sa",
)

# Rows that one task sorts at a time, which bounds its memory.
PART_ROWS = 1 << 18


def statement_signature(df: DataFrame) -> list[Column]:
    """Bank, tax id, account digits, period and declared sums, normalized."""
    def text(name):
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))

    return [
        F.lower(text("bank")).alias("_bank"),
        F.upper(text("rfc")).alias("_rfc"),
        digits(F.col("clabe")).alias("_clabe"),
        F.lower(text("period_start")).alias("_from"),
        F.lower(text("period_end")).alias("_to"),
        F.round(F.coalesce(F.col("deposits"), F.lit(0)), 2).alias("_in"),
        F.round(F.coalesce(F.col("charges"), F.lit(0)), 2).alias("_out"),
    ]


def mark_duplicates(covers: DataFrame, order, job: str = "job_id") -> DataFrame:
    """Adds ``duplicate``: all but the first statement, in upload order, of one signature and job.

    The first is found by a grouped minimum, so many copies of one statement do not gather.
    """
    keys = ["_bank", "_rfc", "_clabe", "_from", "_to", "_in", "_out"]
    at = F.struct(*order)
    signed = covers.select("*", *statement_signature(covers))
    first = signed.groupBy(job, *keys).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return attach_group(signed, first, [job, *keys]).withColumn("duplicate", at > F.col("_first")).drop(*keys, "_first")


def dedup_statements(covers: DataFrame, order, job: str = "job_id") -> DataFrame:
    return mark_duplicates(covers, order, job).filter(~F.col("duplicate")).drop("duplicate")


def keywords(text: Column, ignored=IGNORED_WORDS) -> Column:
    """Distinct words of three or more characters that carry meaning."""
    words = F.split(F.lower(text), r"\W+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*ignored)))


def _sided(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``_side``, true for parents and false for children, and ``_key``, their amount in cents.

    Rows that can match no other have no side, and a key that only spreads them.
    """
    cents = F.round(F.col("amount") * 100).cast("bigint")
    able = F.col("doc_id").isNotNull() & cents.isNotNull() & F.col("role").isin("parent", "child")
    return rows.withColumns({"_side": F.when(able, F.col("role") == "parent"), "_key": F.when(able, cents).otherwise(F.xxhash64(order))})


def _bit(word: Column) -> Column:
    """One of 64 bits, so that a number tells which words a set can't have."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(word), F.lit(64)))


def _matched(dealt: DataFrame, order: str, carried: list[str], any_date: bool, ignored) -> DataFrame:
    """Adds ``_parent``, the row that takes up a child, and ``_found``, the parents of its day and amount, to sided rows.

    They are dealt by document and ``_key``, and all windows lie within these, so no row travels. A row goes through
    the words once as itself, with the ``carried`` columns, and once for each of its words, without them.
    """
    keys, itself = ["doc_id", "_key"], F.col("_word").isNull()
    child, parent_at, a_parent = ~F.col("_side"), F.when(F.col("_side"), F.col(order)), F.when(F.col("_side"), 1)
    group, day = Window.partitionBy(*keys), Window.partitionBy(*keys, "posted")
    found = F.when(F.col("posted").isNotNull(), F.count(a_parent).over(day)).otherwise(F.lit(0))
    undecided = child & ((F.col("_found") != 1) if any_date else (F.col("_found") > 1))
    counted = dealt.withColumns({"_found": found, "_only": F.min(parent_at).over(day)})
    counted = counted.withColumn("_only", F.when(child & (F.col("_found") == 1), F.col("_only")))
    words = F.when(F.col("_side") | undecided, keywords(F.col("description"), ignored))
    counted = counted.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    counted = counted.withColumn("_bits", F.aggregate("_words", F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(_bit(w))))
    # a word that no row of the other side can have is not looked for
    other = F.when(F.col("_side"), F.bit_or(F.when(undecided, F.col("_bits"))).over(group)).otherwise(F.bit_or(F.when(F.col("_side"), F.col("_bits"))).over(group))
    counted = counted.withColumns({"_other": F.coalesce(other, F.lit(0)), "_id": F.monotonically_increasing_id()})
    looked = F.filter("_words", lambda w: F.col("_other").bitwiseAND(_bit(w)) != 0)
    each = counted.withColumn("_word", F.explode(F.concat(F.array(F.lit(None).cast("string")), looked)))
    each = each.select(*keys, "posted", order, "_side", "_found", "_only", "_id", "_word", *[F.when(itself, F.col(c)).alias(c) for c in carried])
    met = each.withColumn("_near", F.min(parent_at).over(Window.partitionBy(*keys, "_word", "posted")))
    if any_date:
        met = met.withColumn("_any", F.min(parent_at).over(Window.partitionBy(*keys, "_word")))
        met = met.withColumn("_near", F.when(F.col("_found") > 1, F.col("_near")).otherwise(F.col("_any")))
    shared = F.min(F.when(undecided & ~itself, F.col("_near"))).over(Window.partitionBy(*keys, "_id"))
    return met.withColumn("_shared", shared).filter(itself).withColumn("_parent", F.coalesce("_only", "_shared"))


def match_fragments(
    rows: DataFrame, order: str = "mov_id", any_date: bool = True, ignored=IGNORED_WORDS
) -> DataFrame:
    """Child rows against the parent row that repeats them: (doc_id, child, parent, only_candidate).

    A child takes the only parent of its document, date and amount. With several, it takes the
    first in order that shares a keyword; with none, the first of the same amount on any date that
    shares a keyword (``any_date``). Rows travel once, by document and amount, and windows find the first
    parent of a day and of a keyword, so a key with many parents and children does not pair them all.
    """
    sided = _sided(rows.select("doc_id", "posted", "amount", "description", "role", order), order).filter(F.col("_side").isNotNull())
    met = _matched(sided.drop("amount", "role").repartition("doc_id", "_key"), order, [], any_date, ignored)
    return met.filter(F.col("_parent").isNotNull()).select(
        "doc_id", F.col(order).alias("child"), F.col("_parent").alias("parent"), (F.col("_found") == 1).alias("only_candidate")
    )


def match_fragment_sums(fragments: DataFrame, parents: DataFrame, unit: float = 0.01) -> DataFrame:
    """Fragments of one day and reference whose sum is one parent's amount.

    Returns one row per fragment: (doc_id, parent, ref, child, fragments). Groups of a single
    fragment are left to the one-to-one match. ``unit`` is the amount below which sums are equal.
    """
    flat = F.translate(F.col("description"), "-\n", "")
    ref = F.coalesce(F.nullif(F.regexp_extract(flat, r"(\d{8,15})", 1), F.lit("")), F.lit("GENERICO"))
    frag = fragments.select("doc_id", "posted", ref.alias("ref"), F.col("mov_id").alias("child"), "amount")
    groups = frag.groupBy("doc_id", "posted", "ref").agg(F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("fragments"))
    step = F.lit(unit)
    per_amount = parents.groupBy("doc_id", "posted", F.round(F.col("amount") / step).cast("bigint").alias("_key")).agg(
        F.count(F.lit(1)).alias("_parents"), F.min("mov_id").alias("parent")
    )
    hits = (
        groups.filter(F.col("fragments") > 1)
        .withColumn("_key", F.round(F.col("_sum") / step).cast("bigint"))
        .join(per_amount.filter(F.col("_parents") == 1), ["doc_id", "posted", "_key"])
        .select("doc_id", "posted", "ref", "parent", "fragments", F.col("fragments").alias("_n"))
    )
    return attach_group(frag, hits, ["doc_id", "posted", "ref"]).filter(F.col("parent").isNotNull()).select(
        "doc_id", "parent", "ref", "child", "fragments"
    )


def apply_fragments(rows: DataFrame, order: str = "mov_id", unit: float = 0.01) -> DataFrame:
    """The rows without the children that a parent repeats, whose texts the parents have taken up.

    ``rows`` has doc_id, mov_id, posted, amount, description, role and ``fragment``. Fragments that sum up to
    one parent go first, behind DESGLOSE; the other children are matched one by one among what is left.
    Texts follow the order of their groups and rows. A child that is matched alone has its parent's amount, so
    rows and texts travel once, by document and amount, and once more only if the sums are too many to broadcast.
    """
    names = rows.columns
    rows = cut(rows, "zstd")  # read by the sums and for the texts
    piece = F.coalesce((F.col("role") == "child") & F.col("fragment"), F.lit(False))
    sums = match_fragment_sums(rows.filter(piece).select("doc_id", "posted", "description", "amount", F.col(order).alias("mov_id")),
                               rows.filter("role = 'parent'").select("doc_id", "posted", "amount", F.col(order).alias("mov_id")), unit)
    sums = cut(sums.select("doc_id", "parent", "ref", "child"))

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["t"]), " | ")

    # what became of the rows of a sum: the parent has texts, its fragments have none
    flat = rows.filter(piece).select("doc_id", F.col(order).alias("child"), F.trim(F.replace("description", F.lit("\n"), F.lit(" "))).alias("t"))
    text = F.concat(F.lit(" | DESGLOSE: "), joined(F.collect_list(F.struct("child", "t"))))
    summed = sums.join(flat, ["doc_id", "child"]).groupBy("doc_id", "parent", "ref").agg(text.alias("text"), F.collect_set("child").alias("gone"))
    summed = summed.groupBy("doc_id", "parent").agg(F.array_sort(F.collect_list(F.struct("ref", "text", "gone"))).alias("p"))
    gone = F.transform(F.array_distinct(F.flatten("p.gone")), lambda c: F.struct(F.lit(None).cast("string").alias("text"), c.alias("at")))
    became = F.explode(F.concat(F.array(F.struct(F.array_join("p.text", "").alias("text"), F.col("parent").alias("at"))), gone))
    became = cut(summed.select("doc_id", became.alias("b")).select("doc_id", F.col("b.text").isNull().alias("_gone"), F.col("b.text").alias("_parts"), F.col("b.at").alias(order)))
    left = _sided(rows.join(became, ["doc_id", order], "left").filter(~F.coalesce("_gone", F.lit(False))).drop("_gone"), order)
    left = left.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS)), "doc_id", "_key")

    # a child goes to its parent; a row that is no parent stays by itself
    carried = [c for c in [*names, "_parts"] if c not in ("doc_id", "posted", order)]
    met = _matched(left, order, carried, True, IGNORED_WORDS)
    goes, stays = F.col("_parent").isNotNull(), F.col("_parent").isNull()
    met = met.withColumns({"_to": F.when(goes, F.col("_parent")).when(F.col("_side"), F.col(order)), "_child": F.struct(F.col(order).alias("at"), F.col("description").alias("t"))})
    met = met.withColumn("_own", F.when(F.col("_to").isNull(), F.monotonically_increasing_id()))
    whole = met.groupBy("doc_id", "_key", "_to", "_own").agg(
        F.collect_list(F.when(goes, F.col("_child"))).alias("_ones"), F.collect_list(F.when(stays, F.struct(*[c for c in names if c != "doc_id"], "_parts"))).alias("_rows")
    )
    ones = F.when(F.size("_ones") > 0, F.concat(F.lit(" | "), joined(F.col("_ones"))))
    whole = whole.select("doc_id", F.coalesce(ones, F.lit("")).alias("_ones"), F.explode("_rows").alias("_row")).select("doc_id", "_ones", "_row.*")
    whole = whole.withColumn("description", F.concat("description", F.coalesce("_parts", F.lit("")), "_ones"))
    # sorted and matched once, however often the result is read
    whole = cut(whole.select(*[c for c in names if c != order], F.col(order).alias("child")), "zstd")
    return whole.withColumnRenamed("child", order).select(*names)


# Words that mark a main-section row as a transfer, and one more word without meaning.
TRANSFER_WORDS = ("SPEI", "SPEL", "TRASPASO", "TRANSF", "TRANSFERENCIA", "PAGO", "NETNM", "SOBRANTE")
SCAN_IGNORED_WORDS = IGNORED_WORDS + ("banco",)


def match_transfer_details(rows: DataFrame, order: str = "mov_id") -> DataFrame:
    """Transfer listings of scanned statements against the main section's transfer rows.

    ``rows`` has doc_id, mov_id, date_text, amount, description and section. Only main-section rows
    with a transfer word can be parents, the day of the month is the date key, and a child without
    a parent on its day stays alone.
    """
    main = F.col("section") == "PRINCIPAL"
    words = F.upper("description").rlike("|".join(TRANSFER_WORDS))
    role = F.when(main & words, "parent").when(F.col("section").isin("SPEI_RECIBIDOS", "SPEI_ENVIADOS"), "child").otherwise("other")
    prepared = rows.withColumns({"posted": F.left("date_text", F.lit(2)), "role": role})
    return match_fragments(prepared, order, any_date=False, ignored=SCAN_IGNORED_WORDS)
