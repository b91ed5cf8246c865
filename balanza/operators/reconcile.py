"""Reconciliation: running balances, three-source covers, identity inherited along a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, IntegralType

from balanza.functions.money import amount_or_null, is_credit
from balanza.operators.ordered import fold_starts, last_known, running_sum
from balanza.rules.banks import KAPITAL_CHARGES, KAPITAL_DEPOSITS
from balanza.session import cut


def running_balance(df: DataFrame, opening: Column, order, block: Column, keys=("doc_id",)) -> DataFrame:
    """Adds ``expected``, ``review`` and ``inferred`` to movements with a read ``balance``.

    The expected balance is the opening plus credits minus charges so far. A row is up for review
    when its balance is missing or more than one cent off; then the expected value is carried.
    """
    change = (
        F.when(is_credit(F.col("kind")), F.col("amount"))
        .when(F.lower(F.trim("kind")) == "cargo", -F.col("amount"))
        .otherwise(F.lit(0))
    )
    scanned = running_sum(df, keys, order, {"_moved": change}, block)
    expected = F.col("_moved") + opening
    off = F.col("balance").isNull() | (F.abs(F.col("balance") - expected) > F.lit(0.01).cast("decimal(4,2)"))
    return scanned.withColumns({
        "expected": expected, "review": off, "inferred": F.when(off, expected),
    }).drop("_moved")


def running_balance_strict(df: DataFrame, opening: Column, order, block: Column | str, keys=("doc_id",)) -> DataFrame:
    """Adds ``expected``, ``review``, ``inferred`` and ``carried``: like ``running_balance``, but a read balance that is
    at most one cent off is carried on instead of the expected one, so that cents add up along the document.

    With the changes taken off, the carried balance is one number that a row moves only if its own number differs
    by a cent. So a block of rows is a function of where it starts: the start itself, but for a few starts near the
    numbers read in it. These functions are composed over the blocks, and each block is walked from its own start.
    Numbers that no chain of cents leads to from the opening never count and are left out of the functions. ``block``
    never decreases along ``order``, which is unique in a document; it may be the name of a column by which the rows lie
    together already. The keys are not null, and the opening is one value for a document.

    The rows are written once with their numbers inside the block; what follows reads a few narrow columns of them,
    and they travel once more to meet the starts of their blocks.
    """
    keys = list(keys)
    change = (
        F.when(is_credit(F.col("kind")), F.col("amount"))
        .when(F.lower(F.trim("kind")) == "cargo", -F.col("amount"))
        .otherwise(F.lit(0))
    )

    def cents(x: Column) -> Column:
        return F.round(x * 100).cast("long")

    # changes in whole cents add up inside the block; finer ones are summed up before they are rounded
    if _whole_cents(df.schema["amount"].dataType):
        rows, moved, step = df, None, cents(change)
    else:
        rows, moved, step = running_sum(df, keys, order, {"_moved": change}, block), cents(F.col("_moved")), F.lit(0).cast("long")
    at = block if isinstance(block, str) else "_at"
    rows = (rows if isinstance(block, str) else rows.withColumn(at, block)).withColumns({"_open": cents(opening), "_step": F.coalesce(step, F.lit(0))})
    inside = Window.partitionBy(*keys, at).orderBy(*order)
    up_to, before = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    rows = rows.withColumn("_q", F.sum("_step").over(up_to) if moved is None else moved)
    rows = rows.withColumn("_r", cents(F.col("balance")) - F.col("_q"))
    # only a number that differs from the one read before it can move the balance
    last = F.last("_r", ignorenulls=True).over(before)
    rows = rows.withColumn("_new", (F.col("_r").isNotNull() & ~F.col("_r").eqNullSafe(last)).cast("int"))
    rows = rows.withColumn("_nth", F.sum("_new").over(up_to))
    rows = cut(rows.select(*df.columns, *([] if isinstance(block, str) else [at]), "_open", "_step", "_q", "_r", "_new", "_nth"))

    earlier_blocks = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, at).agg(F.sum("_step").alias("_sum"), F.first("_open").alias("_open"))
    sums = sums.select(*keys, at, "_open", F.coalesce(F.sum("_sum").over(earlier_blocks), F.lit(0)).alias("_off"))
    read = rows.filter("_new = 1").groupBy(*keys, at).agg(F.sort_array(F.collect_list(F.struct("_nth", "_r"))).alias("_read"))
    blocks = sums.join(read, [*keys, at], "left").withColumn("_read", F.transform(
        F.coalesce("_read", F.array().cast("array<struct<_nth:bigint,_r:bigint>>")), lambda x: x["_r"] - F.col("_off")
    ))
    blocks = cut(blocks.select(*keys, at, "_open", "_off", "_read"))

    def earlier(ends: Column, d: Column) -> Column:
        end = F.coalesce(F.try_element_at(ends, d), d)
        others = F.map_filter(ends, lambda k, _: F.abs(k - d) > 1)
        return F.map_concat(others, F.map_from_arrays(F.array(d - 1, d, d + 1), F.array(end, end, end)))

    none = F.create_map().cast("map<bigint,bigint>")
    near = F.filter("_read", lambda d: d.between(F.col("_low"), F.col("_high")))
    ends = blocks.join(_within_cents(blocks, keys), keys).withColumn("_map", F.aggregate(F.reverse(near), none, earlier))
    ends = cut(ends.select(*keys, at, "_open", F.map_keys("_map").alias("_from"), F.map_values("_map").alias("_to")))
    starts = fold_starts(ends, keys, at, F.col("_open"), "_from", "_to", "_start")

    def walked(seen: Column, d: Column) -> Column:
        last = F.element_at(seen, -1)
        return F.concat(seen, F.array(F.when(F.abs(last - d) <= 1, d).otherwise(last)))

    states = blocks.select(*keys, at, "_off", "_read").join(starts, [*keys, at])
    states = states.select(*keys, at, "_off", F.aggregate("_read", F.array("_start"), walked).alias("_states"))
    state = F.get("_states", F.col("_nth") - F.col("_new"))
    review = F.col("_r").isNull() | (F.abs(state - (F.col("_r") - F.col("_off"))) > 1)
    expected = ((state + F.col("_off") + F.col("_q")).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(20,2)")
    out = rows.join(states, [*keys, at]).withColumns({"expected": expected, "review": review})
    out = out.withColumns({"inferred": F.when(F.col("review"), F.col("expected")), "carried": F.when(F.col("review"), F.col("expected")).otherwise(F.round("balance", 2).cast("decimal(20,2)"))})
    return out.select(*df.columns, "expected", "review", "inferred", "carried")


def _whole_cents(kind) -> bool:
    return isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.scale <= 2


def _within_cents(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _low, _high): the chain of numbers, each a cent from the next, that the opening is in."""
    seen = blocks.select(*keys, F.explode(F.array_distinct("_read")).alias("_d")).union(blocks.select(*keys, "_open")).distinct()
    part = F.floor(F.col("_d") / 256)
    gaps = last_known(seen, keys, ["_d"], {"_before": F.col("_d")}, part, inclusive=False)
    gap = F.when(F.col("_d") - F.col("_before") > 1, 1).otherwise(0)
    chains = running_sum(gaps, keys, ["_d"], {"_chain": gap}, part).select(*keys, "_d", "_chain")
    own = chains.join(blocks.select(*keys, F.col("_open").alias("_d")).distinct(), [*keys, "_d"]).select(*keys, "_chain")
    return chains.join(own, [*keys, "_chain"]).groupBy(*keys).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"))


def reconcile_sources(df: DataFrame, numeric=(), exact=(), text=()) -> DataFrame:
    """One value per field from three sources: structs ``a`` and ``b`` (models) and ``rx`` (patterns).

    Numbers: agreement of ``a`` and ``b``, else the one that agrees with ``rx``, else ``b``, else
    ``a``. Ids: the pattern when it is 12 characters or longer, else by length. Texts: ``a`` unless
    it says nothing.
    """
    cols = {}
    for f in numeric:
        a, b, rx = F.col(f"a.{f}"), F.col(f"b.{f}"), F.col(f"rx.{f}")
        cols[f] = F.when(a == b, a).when(a == rx, a).when(b == rx, b).otherwise(F.coalesce(b, a))
    for f in exact:
        a = F.trim(F.coalesce(F.col(f"a.{f}"), F.lit("")))
        b = F.trim(F.coalesce(F.col(f"b.{f}"), F.lit("")))
        rx = F.col(f"rx.{f}")
        b_wins = F.length(b) == 18 if f == "clabe" else F.length(b) >= F.length(a)
        cols[f] = F.when(F.length(rx) >= 12, F.upper(rx)).when(b_wins, b).otherwise(a)
    for f in text:
        a = F.trim(F.coalesce(F.col(f"a.{f}"), F.lit("")))
        b = F.trim(F.coalesce(F.col(f"b.{f}"), F.lit("")))
        cols[f] = F.when(F.lower(a).isin("", "none", "null"), b).otherwise(a)
        if f == "bank":
            cols[f] = F.coalesce(F.col("rx.bank"), cols[f])
    return df.withColumns(cols)


def kapital_sums(df: DataFrame, bank: str = "bank") -> DataFrame:
    """For the bank that declares its sums in parts: deposits of 6 and charges of 8 addends."""
    def total(parts):
        out = F.lit(0.0)
        for p in parts:
            out = out + F.coalesce(F.col(p), F.lit(0.0))
        return out

    own = F.upper(F.col(bank)) == "KAPITAL"
    return df.withColumns({
        "deposits": F.when(own, total(KAPITAL_DEPOSITS)).otherwise(F.col("deposits")),
        "charges": F.when(own, total(KAPITAL_CHARGES)).otherwise(F.col("charges")),
    })


def inherit_identity(df: DataFrame, key: str, order, block: Column) -> DataFrame:
    """A row without a holder takes the last one seen before it when the tax ids match."""
    rfc, holder = F.coalesce("rfc", F.lit("")), F.coalesce("holder", F.lit(""))
    seen = F.when((rfc != "") & (holder != ""), F.struct(F.col("rfc").alias("rfc"), F.col("holder").alias("holder")))
    memo = last_known(df, [key], order, {"_memo": seen}, block)
    inherits = (holder == "") & (rfc == F.coalesce("_memo.rfc", F.lit("")))
    return memo.withColumn(
        "holder", F.when(inherits, F.coalesce("_memo.holder", F.lit(""))).otherwise(F.col("holder"))
    ).drop("_memo")


def coerce_fields(df: DataFrame, strings=(), numbers=()) -> DataFrame:
    """Listed fields to text, or to clean numbers with 0 for what is none."""
    return df.withColumns({
        **{c: F.col(c).cast("string") for c in strings if c in df.columns},
        **{c: F.coalesce(amount_or_null(F.col(c).cast("string")), F.lit(0.0)) for c in numbers if c in df.columns},
    })
