"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Targets share the whole size by weight, stop at a multiple of a source's size, and pass the excess on. Blocks
of equal size go to sources by the highest quotients target / (2 n + 1), and a source's blocks to its
shards in the same way. In a shard, documents in seeded order make one stream of words that is cut into blocks;
the mix takes the first blocks, and begins again at its end. So a shard's quota is whole blocks, its documents
are taken whole but for one, and nothing depends on how rows are partitioned.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from balanza.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 4
#: A shard holds about so many words; a source has at most MAX_SHARDS, then larger ones.
SHARD_WORDS = 1 << 17
MAX_SHARDS = 4096


def targets(sizes: Sequence[int], weights: Sequence[float], repeat: float = 3) -> list[float]:
    """The shares by weight of the total size, each at most ``repeat`` times its size, the rest reshared."""
    out: list[float] = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > repeat * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(repeat * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def apportion(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 n + 1), none above ``most``; ties go to the first."""
    given = [0] * len(votes)
    open_ = {i for i, v in enumerate(votes) if v > 0 and most[i] > 0}
    left = min(seats, sum(most[i] for i in open_))
    # near the answer by one common divisor; parties that reach their limit leave
    while open_ and left > 0:
        divisor = sum(votes[i] for i in open_) / left
        full = {i for i in open_ if votes[i] / divisor >= most[i]}
        if not full:
            break
        for i in full:
            given[i] = most[i]
        left -= sum(most[i] for i in full)
        open_ -= full
    if not open_ or left <= 0:
        return given
    for i in open_:
        given[i] = min(most[i], int(votes[i] / divisor + 0.5))
    short = left - sum(given[i] for i in open_)
    if short > 0:
        heap = [(-votes[i] / (2 * given[i] + 1), i) for i in open_ if given[i] < most[i]]
        heapq.heapify(heap)
        while short and heap:
            _, i = heapq.heappop(heap)
            given[i] += 1
            short -= 1
            if given[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    else:
        heap = [(votes[i] / (2 * given[i] - 1), -i) for i in open_ if given[i]]
        heapq.heapify(heap)
        while short < 0 and heap:
            _, i = heapq.heappop(heap)
            given[-i] -= 1
            short += 1
            if given[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * given[-i] - 1), i))
    return given


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _shard_quotas(block: int, repeat: int):
    def run(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        words = [int(x) for x in shards["words"]]
        got = apportion(words, int(shards["blocks"].iloc[0]), [repeat * w // block for w in words])
        return pd.DataFrame({"sid": shards["sid"], "shard": shards["shard"], "words": shards["words"], "quota": [b * block for b in got]})

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, repeat: int = 3, seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """(id, h, size, source_size, target, taken, begins) for every row: how many of its words the mix takes.

    ``size`` counts runs of anything but ASCII white space; null and empty texts have none and are never taken.
    Sources in code point order, null last, weigh ``weights`` again and again. ``h`` is the hash of the text
    and ``begins`` its place in its shard's stream. Repeated rows are documents of their own. The table of
    sources comes to the driver, as a mixture is stated for each; shards and documents do not.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h")))
    sizes = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    pull = targets([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], repeat)
    blocks = apportion(pull, int(sum(pull) / block + 0.5), [repeat * sizes[s] // block for s in names])
    plan = spark.createDataFrame(
        [(i, s, sizes[s], t, b, max(1, min(MAX_SHARDS, -(-sizes[s] // SHARD_WORDS)))) for i, (s, t, b) in enumerate(zip(names, pull, blocks, strict=True))],
        "sid int, source string, source_size long, target double, blocks long, shards long",
    )
    order = F.xxhash64(F.lit(seed), "id", "h")
    kind = docs.schema[source_col].dataType
    plan = plan.withColumn("source", F.col("source").cast(kind))
    placed = rows.join(plan, rows.source.eqNullSafe(plan.source)).select(
        "id", "h", "size", "sid", "source_size", "target", "blocks", order.alias("o"), F.pmod(F.xxhash64(F.lit(seed + 1), "id", "h"), "shards").alias("shard")
    )
    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = cut(shards.groupBy("sid").applyInPandas(_shard_quotas(block, repeat), "sid int, shard long, words long, quota long"))
    stream = Window.partitionBy("sid", "shard").orderBy("o", "id", "h", "size")
    begins = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = placed.withColumn("begins", begins).join(quotas, ["sid", "shard"])
    rounds = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0)
    rest = F.col("quota") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begins")))
    return out.select(F.col("id").alias(id_col), "h", "size", "source_size", "target", taken.cast("long").alias("taken"), "begins")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix: a row for each time a text is taken whole, and one with its first words
    (joined by blanks) where only those are taken. All columns of ``docs`` stay; rows of equal id and text
    are expected once (equal rows share what the first of them gets)."""
    plan = mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    plan = plan.groupBy(F.col(id_col).alias("mix_id"), F.col("h").alias("mix_h")).agg(F.min("size").alias("mix_size"), F.min("taken").alias("mix_taken"))
    # the documents' own columns travel as one, so that no name clashes
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    id_, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    found = own.join(plan, id_.eqNullSafe(F.col("mix_id")) & (F.xxhash64(text) == F.col("mix_h")))
    whole = F.floor(F.col("mix_taken") / F.col("mix_size")).cast("int")
    part = (F.col("mix_taken") % F.col("mix_size")).cast("int")
    words = F.array_repeat(F.col("mix_size").cast("int"), whole)
    found = found.withColumn("mix_words", F.explode(F.concat(words, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1), 1, F.col("mix_words")), " ")
    taken = F.when(F.col("mix_words") < F.col("mix_size"), head).otherwise(text)
    return found.select(*[taken.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
