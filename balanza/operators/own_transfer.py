"""Transfers between accounts of the same job: by account number and by holder name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.ids import account_keys
from balanza.functions.money import is_credit
from balanza.functions.plan import settle
from balanza.functions.text import clean_company, matching_ratio, to_ascii
from balanza.operators.ordered import attach_group
from balanza.rules.tags import PROTECTED_CATEGORIES
from balanza.session import cut


def account_pool(covers: DataFrame) -> DataFrame:
    """Distinct (job_id, account): each account number and, for 18 digits, its last 10 and 11."""
    return covers.select("job_id", F.explode(account_keys(F.col("clabe"))).alias("account")).distinct()


def name_pool(covers: DataFrame) -> DataFrame:
    """Distinct (job_id, name): cleaned holder names of four characters or more."""
    return (
        covers.select("job_id", clean_company(F.col("holder")).alias("name"))
        .filter(F.length("name") >= 4)
        .distinct()
    )


def own_by_account(mov: DataFrame, pool: DataFrame, key: str = "mov_id") -> DataFrame:
    """Keys of movements whose text holds an account number of the same job."""
    numbers = mov.select(
        "job_id", key,
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"\b(\d{10,18})\b"), F.lit(1)))).alias("account"),
    )
    return numbers.join(pool, ["job_id", "account"], "left_semi").select("job_id", key).distinct()


def name_text(text: Column) -> Column:
    """Description as it is compared with names: folded, no punctuation."""
    return F.regexp_replace(to_ascii(F.lower(text), lowered=True), r"[^\w\s]", "")


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _windows(tokens: Column, words: Column) -> Column:
    """Runs of ``words`` tokens; ``tokens`` is a column, since it is read for each run."""
    count = F.size(tokens) - words + 1
    starts = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, words), " "))


#: Bits of the tables that rule out what no name has.
TABLE_BITS = 1 << 22


def _bit_table(values: DataFrame, *cols: str) -> Column:
    """Bits of the hashes of ``cols`` as words of 64, a table of fixed size."""
    at = F.pmod(F.xxhash64(*cols), F.lit(TABLE_BITS))
    bits = values.select(F.floor(at / 64).cast("long").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("_bits"))
    every = values.sparkSession.range(TABLE_BITS // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = bits.unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("_table")).scalar()


def _in_table(table: Column, *cols: Column) -> Column:
    at = F.pmod(F.xxhash64(*cols), F.lit(TABLE_BITS))
    return F.getbit(F.get(table, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1


def own_by_name_exact(mov: DataFrame, names: DataFrame, key: str = "mov_id") -> DataFrame:
    """Keys of movements whose text contains a holder name of the same job.

    Places of a text where no name of the job can begin are ruled out by a bit table of first four characters, and pieces
    as long as a name by a second one of whole names, in the task and before any shuffle. What is left meets the names by
    job and piece, and that join decides; a text itself travels nowhere.
    """
    names = cut(names.select("job_id", "name").distinct())
    first = _bit_table(names.select("job_id", F.left("name", F.lit(4)).alias("_gram")), "job_id", "_gram")
    whole = _bit_table(names, "job_id", "name")
    sizes = names.agg(F.sort_array(F.collect_set(F.length("name"))).alias("_sizes")).scalar()
    text = mov.select("job_id", key, name_text(F.col("description")).alias("_text"))
    job, n = F.col("job_id"), F.length("_text")
    at = text.select("*", F.explode(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1)))).alias("_at"))
    at = at.filter(_in_table(first, job, F.substr(F.col("_text"), F.col("_at"), F.lit(4))))
    sized = at.select("*", sizes.alias("_sizes")).select("job_id", key, "_text", "_at", F.explode("_sizes").alias("_size")).filter(F.col("_at") + F.col("_size") - 1 <= n)
    pieces = settle(sized.select("job_id", key, "_text", "_at", "_size"), {"name": F.substr(F.col("_text"), F.col("_at"), F.col("_size"))})
    found = pieces.filter(_in_table(whole, job, F.col("name"))).select("job_id", key, "name")
    return found.join(names, ["job_id", "name"], "left_semi").select("job_id", key).distinct()


def own_by_name_fuzzy(mov: DataFrame, names: DataFrame, key: str = "mov_id", threshold: float = 0.85) -> DataFrame:
    """Keys of movements with a run of words at least ``threshold`` similar to a holder name.

    The similarity of two texts is 1 - edits / length of the longer one, edits as counted by
    Levenshtein.
    """
    def edits(n: Column, m: Column) -> Column:
        return F.floor(F.lit(1 - threshold) * F.greatest(n, m) + 1e-9).cast("int")

    runs, pairs = _near_names(mov, names, key, edits, F.col("_n") / F.lit(threshold))
    good = pairs.filter(F.levenshtein("name", "_run") <= F.col("_allowed"))
    return _keys_of(runs, good, key)


def own_by_name_ratio(mov: DataFrame, names: DataFrame, key: str = "mov_id", threshold: float = 0.85) -> DataFrame:
    """Keys of movements with a run of words whose matching-block ratio with a holder name is ``threshold`` or more.

    Characters outside of the blocks are inserted or deleted, so the ratio bounds their number by (1-t) of both
    lengths, and edits can't be more. Pairs that come near enough by that are compared block by block.
    """
    def edits(n: Column, m: Column) -> Column:
        return F.floor(F.lit(1 - threshold) * (n + m) + 1e-9).cast("int")

    runs, pairs = _near_names(mov, names, key, edits, F.col("_n") * F.lit((2 - threshold) / threshold))
    near = settle(pairs.filter(F.levenshtein("name", "_run") <= F.col("_allowed")), {"_ratio": matching_ratio(F.col("name"), F.col("_run"))})
    return _keys_of(runs, near.filter(F.col("_ratio") >= threshold), key)


def _keys_of(runs: DataFrame, good: DataFrame, key: str) -> DataFrame:
    found = good.select("job_id", "_words", "_run").distinct()
    return runs.join(found, ["job_id", "_words", "_run"], "left_semi").select("job_id", key).distinct()


def _near_names(mov: DataFrame, names: DataFrame, key: str, edits, widest: Column) -> tuple[DataFrame, DataFrame]:
    """Runs of words of the movements, and the pairs (job_id, _words, _run, name, _allowed) that may be similar.

    ``edits`` gives the edits that two lengths allow, ``widest`` the longest text that a name of ``_n`` characters may
    be similar to. Of one part more than a name has edits at most, at least one is in the run unchanged, no further from
    its place than there are edits. Runs and names of as many words meet on such a part, and pairs whose lengths
    and places allow it are kept. Nothing is left out.
    """
    sized = names.select("job_id", "name", F.length("name").alias("_n"), F.size(F.split("name", " ")).alias("_words"))
    sized = sized.withColumn("_cuts", F.least(edits(F.col("_n"), widest) + 1, F.col("_n")))
    begin = lambda i: F.floor(i * F.col("_n") / F.col("_cuts")).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("_cuts") - 1),
        lambda i: F.struct(begin(i).alias("at"), F.substr(F.col("name"), begin(i) + 1, begin(i + 1) - begin(i)).alias("part")),
    )
    right = sized.select("job_id", "name", "_n", "_words", F.inline(pieces)).withColumnsRenamed({"at": "_at", "part": "_part"})
    # Per job the few word counts its names have, each with its part lengths and name lengths.
    shapes = right.groupBy("job_id", "_words").agg(
        F.collect_set(F.length("_part")).alias("_lens"), F.min("_n").alias("_short"), F.max("_n").alias("_long")
    ).groupBy("job_id").agg(F.collect_list(F.struct("_words", "_lens", "_short", "_long")).alias("_shapes"))
    letters = names.select("job_id", F.explode(F.split("name", "")).alias("_c")).groupBy("job_id").agg(
        F.array_join(F.array_sort(F.collect_set("_c")), "").alias("_letters")
    )
    load = mov.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))

    text = mov.select("job_id", key, _tokens(name_text(F.col("description"))).alias("_text"))
    shaped = attach_group(text, shapes.join(letters, "job_id").join(load, "job_id"), ["job_id"])
    runs = shaped.select("job_id", key, "_text", "_letters", F.explode("_shapes").alias("_s")).select(
        "job_id", key, "_s", "_letters", F.explode(F.array_distinct(_windows(F.col("_text"), F.col("_s._words")))).alias("_run")
    )
    m = F.length("_run")
    # A character that no name of the job has is an edit; it is counted where the length alone does not decide.
    strange = F.length(F.expr("translate(_run, _letters, '')"))
    fits = (m >= F.col("_s._short") - edits(m, F.col("_s._short"))) & (m <= F.col("_s._long") + edits(m, F.col("_s._long")))
    runs = runs.filter(F.when(fits, strange <= edits(m, F.col("_s._long"))).otherwise(False))
    # They are read twice, for the pairs and for the keys of those that fit.
    runs = cut(runs.select("job_id", key, F.col("_s._words").alias("_words"), F.col("_s._lens").alias("_lens"), "_run"))
    distinct_runs = runs.groupBy("job_id", "_words", "_run").agg(F.first("_lens").alias("_lens"))
    grams = F.flatten(F.transform("_lens", lambda size: F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("_run") - size, F.lit(0))), lambda i: F.struct(i.alias("_from"), F.substr(F.col("_run"), i + 1, size).alias("_part"))
    )))
    left = distinct_runs.select("job_id", "_words", "_run", F.inline(grams))
    allowed = edits(F.length("_run"), F.col("_n"))
    near = (F.abs(F.length("_run") - F.col("_n")) <= allowed) & (F.abs(F.col("_from") - F.col("_at")) <= allowed)
    pairs = left.join(right, ["job_id", "_words", "_part"]).filter(near).select("job_id", "_words", "_run", "name", allowed.alias("_allowed")).distinct()
    return runs, pairs


def apply_own(mov: DataFrame, *own: DataFrame, key: str = "mov_id", kind: str = "kind") -> DataFrame:
    """Marks own transfers and recategorizes them unless the category is protected."""
    marks = own[0]
    for other in own[1:]:
        marks = marks.unionByName(other)
    marks = marks.distinct().withColumn("_own", F.lit(True))
    open_category = ~F.upper(F.trim("category")).isin(*PROTECTED_CATEGORIES)
    side = F.when(is_credit(F.col(kind)), F.lit("TRASPASO_ABONO")).otherwise(F.lit("TRASPASO_CARGO"))
    return (
        mov.join(marks, ["job_id", key], "left")
        .withColumns({
            "suspicious": F.coalesce("_own", F.lit(False)),
            "category": F.when(F.col("_own") & open_category, side).otherwise(F.col("category")),
        })
        .drop("_own")
    )


def transfer_totals(mov: DataFrame, by=("job_id", "doc_id")) -> DataFrame:
    """Sums of transfers in and out per document, after own transfers are marked."""
    def total(cat):
        return F.coalesce(F.sum(F.when(F.col("category") == cat, F.col("amount"))), F.lit(0))

    return mov.groupBy(*by).agg(
        total("TRASPASO_ABONO").alias("transfers_in"), total("TRASPASO_CARGO").alias("transfers_out")
    )
