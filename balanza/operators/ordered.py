"""Ordered scans and group lookups that survive a hot group.

A plain window over one key puts the whole key in one task. Here an ordered scan runs in two
steps: inside blocks of the key (a page, a month, a run of positions) and over one summary row
per block. A block is any expression that never decreases along the order, so the block rows keep
the order of the rows. Only the summary rows of a key meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, keys, order, values: dict[str, Column], block: Column | str) -> DataFrame:
    """Running sums in order, one output column per entry of ``values``.

    A block that is the name of a column stays, and the rows lie together by key and block afterwards.
    """
    keys = list(keys)
    at = block if isinstance(block, str) else "_block"
    data = df if isinstance(block, str) else df.withColumn(at, block)
    inside = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = data.groupBy(*keys, at).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    starts = totals.select(
        *keys, at, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values]
    )
    scanned = data.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    joined = scanned.join(starts, [*keys, at])
    return joined.withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in values}).drop(
        "_block", *[f"_s_{n}" for n in values]
    )


def position(df: DataFrame, keys, order, block: Column, name: str = "seq") -> DataFrame:
    """1-based position of each row in its key; ``order`` must be unique within the key."""
    return running_sum(df, keys, order, {name: F.lit(1)}, block)


def last_known(df: DataFrame, keys, order, values: dict[str, Column], block: Column, inclusive: bool = True) -> DataFrame:
    """Last value that was not NULL up to each row, per entry of ``values``; the row's own value
    counts unless ``inclusive`` is false."""
    keys = list(keys)
    data = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    ends = data.groupBy(*keys, "_block").agg(
        *[F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), at)).alias(f"_e_{n}") for n, v in values.items()]
    )
    carried = ends.select(
        *keys, "_block", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    scanned = data.withColumns({n: F.last(v, ignorenulls=True).over(inside) for n, v in values.items()})
    joined = scanned.join(carried, [*keys, "_block"])
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values}).drop(
        "_block", *[f"_c_{n}" for n in values]
    )


#: Blocks whose functions are composed in one row.
SPAN = 1000


def fold_starts(blocks: DataFrame, keys, block: str, opening: Column, source: str, target: str, name: str) -> DataFrame:
    """(keys, block, ``name``): the state in which each block of a key starts.

    A block is a function from the state before it to the state after it: the entry of ``target`` at the place where
    the state stands in ``source``, or the state itself when it is not there. The first block starts from ``opening``, one
    value for a key. Functions are composed over spans of ``SPAN`` blocks first, then over the spans of a key, and
    the blocks of a span are walked from the span's own start.
    """
    keys = list(keys)

    def applied(state: Column, f: Column) -> Column:
        return F.coalesce(F.get(f[target], F.array_position(f[source], state) - 1), state)

    def walked(first: Column, functions: Column) -> Column:
        """States before each function, and after the last."""
        return F.aggregate(functions, F.array(first), lambda seen, f: F.concat(seen, F.array(applied(F.element_at(seen, -1), f))))

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(block)) - 1
    placed = blocks.select(*keys, block, source, target, opening.alias("_first")).withColumn("_span", F.floor(nth / SPAN))
    listed = F.sort_array(F.collect_list(F.struct(block, source, target))).alias("_list")
    spans = placed.groupBy(*keys, "_span").agg(F.first("_first").alias("_first"), listed)
    domain = F.array_distinct(F.flatten(F.transform("_list", lambda f: f[source])))
    composed = spans.select(*keys, "_span", "_first", domain.alias(source), "_list").withColumn(
        target, F.transform(source, lambda v: F.aggregate("_list", v, applied))
    )
    per_key = composed.groupBy(*keys).agg(F.first("_first").alias("_first"), F.sort_array(F.collect_list(F.struct("_span", source, target))).alias("_spans"))
    starts = per_key.select(*keys, F.posexplode(F.slice(walked(F.col("_first"), F.col("_spans")), 1, F.size("_spans"))).alias("_span", "_start"))
    each = spans.drop("_first").join(starts, [*keys, "_span"]).withColumn("_states", walked(F.col("_start"), F.col("_list")))
    pairs = F.explode(F.arrays_zip(F.transform("_list", lambda f: f[block]).alias("block"), F.slice("_states", 1, F.size("_list")).alias("state")))
    return each.select(*keys, pairs.alias("_pair")).select(*keys, F.col("_pair.block").alias(block), F.col("_pair.state").alias(name))


def attach_group(df: DataFrame, per_group: DataFrame, keys, weight: str = "_n", hot_share: int = 1000) -> DataFrame:
    """Left join of one row per group onto the rows of the group.

    ``per_group`` carries the group's row count in ``weight``. Groups above 1/``hot_share`` of all
    rows (so at most ``hot_share`` of them) are broadcast; their rows get a spread-out join salt, so
    they do not gather in one task. The other groups join by key, broadcast or shuffled as Spark
    decides from the size.
    """
    keys = list(keys)
    fields = [c for c in per_group.columns if c not in keys and c != weight]
    packed = per_group.select(*keys, weight, F.struct(*fields).alias("_cold"))
    hot = (
        packed.filter(F.col(weight) * hot_share > per_group.agg(F.sum(weight).alias("_all")).scalar())
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cold").alias("_hot"))
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on_hot = match[0]
    for m in match[1:]:
        on_hot = on_hot & m
    tagged = df.join(F.broadcast(hot), on_hot, "left").drop(*[f"_k_{k}" for k in keys])
    salt = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("bigint"))
    cold = packed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_cold", F.lit(0).cast("bigint").alias("_zero"))
    on_cold = F.col("_salt") == F.col("_zero")
    for k in keys:
        on_cold = on_cold & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = tagged.withColumn("_salt", salt).join(cold, on_cold, "left")
    return joined.withColumn("_row", F.coalesce("_hot", "_cold")).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_row.{f}").alias(f) for f in fields]
    )


def top_k(df: DataFrame, partition, by, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per partition; Spark cuts each task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
