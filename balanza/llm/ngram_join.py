"""Exact Jaccard join of documents on word n-grams, by a grouped prefix join.

1. A fixed-size count table over the n-grams of all documents puts frequent n-grams last in one total
   order. The order only decides how much is compared; the result is the same for every order.
2. A document's prefix is its first ``n - ceil(t n) + 1`` n-grams in that order: linked documents share one.
   Documents with equal sets become one class; classes with the same prefix and size become one group.
3. Groups meet at their prefix n-grams, filtered by size and by position. Of n-grams that the same groups have, only
   the first in the order counts: the first n-gram of a pair is always such a one. First groups meet only with the hub
   of an n-gram (the group that has it earliest), which joins most copies into components in linear work; then all
   group pairs that are still in different components, at the first n-gram they share. Prefixes alone rule out most
   pairs that meet.
4. Group pairs are expanded to their classes, and each pair is verified on the whole sets.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from balanza.llm import words as W
from balanza.llm.components import components
from balanza.session import cut

#: Counters of the order's count table, as a power of two: 4 million, 4 MB in each task.
SKETCH_BITS = 22
SEGMENTS = 16
#: n-grams before its own that an entry carries, to tell whether a pair has met already. It saves work only.
EARLIER = 8
#: Bits of the table that picks the texts to verify, as a power of two: 2 MB in each task. It saves work only.
FILTER_BITS = 24


def class_id(grams: np.ndarray) -> int:
    """A 64-bit hash of a set of grams."""
    one, two = W.mix(grams).sum(dtype=np.uint64), W.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(W.mix(np.array([one + two * np.uint64(3) + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def group_id(prefix: np.ndarray, n: int) -> int:
    """A 64-bit hash of a prefix and the size of its set."""
    place = W.mix(np.arange(len(prefix), dtype=np.uint64)) | np.uint64(1)
    total = (W.mix(prefix) * place).sum(dtype=np.uint64)
    return int(W.mix(np.array([total + np.uint64(n)], dtype=np.uint64)).view(np.int64)[0])


def _tally(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        held, size, seen = [], 0, False

        def add() -> None:
            nonlocal held, size
            cells = np.sort((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.uint32))
            edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            counts[cells[edge]] += np.diff(np.append(edge, len(cells))).astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            for part in W.slices(batch, "text"):
                seen = True
                for grams in W.gram_sets(*W.strings(part.column("text")), n):
                    held.append(grams)
                    size += len(grams)
                if size >= 1 << 20:
                    add()
        if size:
            add()
        if seen:
            parts = np.split(counts, SEGMENTS)
            yield pa.RecordBatch.from_pydict(
                {"seg": pa.array(range(SEGMENTS), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())}
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, blob in zip(batch.column("seg").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
            total[seg] = total[seg] + counts if seg in total else counts
    if total:
        yield pa.RecordBatch.from_pydict(
            {"seg": pa.array(list(total), pa.int32()), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())}
        )


def gram_classes(texts: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """A frequency class (0 rare, then one more for each doubling) for each cell of the count table."""
    schema = "seg int, counts binary"
    parts = texts.mapInArrow(_tally(n, bits), schema).withColumn("salt", F.spark_partition_id() % 32)
    merged = parts.repartition("seg", "salt").select("seg", "counts").mapInArrow(_add, schema)
    merged = merged.repartition("seg").mapInArrow(_add, schema)
    counts = np.zeros(1 << bits, dtype=np.float64)
    width = (1 << bits) // SEGMENTS
    for row in merged.collect():  # SEGMENTS rows, of fixed total size
        counts[row.seg * width : (row.seg + 1) * width] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    usual = counts.mean()
    over, limit = counts - usual, 3 * math.sqrt(usual) + 3  # what cells have beyond the usual, and how much of that is chance
    return np.where(over > limit, 1 + np.floor(np.log2(np.maximum(over / limit, 1))), 0).astype(np.uint8)


def _prefixes(n: int, num: int, den: int, classes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        told: set[int] = set()  # groups whose prefix this task has given already
        for batch in batches:
            for part in W.slices(batch, "text"):
                size, cid, gid, prefix = [], [], [], []
                for grams in W.gram_sets(*W.strings(part.column("text")), n):
                    k = len(grams)
                    size.append(k)
                    if not k:
                        cid.append(None), gid.append(None), prefix.append(None)
                        continue
                    key = (table[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
                    key.sort()
                    key = key[: k + (-num * k // den) + 1]
                    cid.append(class_id(grams))
                    gid.append(group_id(key, k))
                    prefix.append(None if gid[-1] in told else key.view(np.int64))
                    told.add(gid[-1])
                if len(told) > 1 << 20:
                    told.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), pa.array(gid, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["id", "n", "cid", "gid", "prefix"],
                )

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    seen = False
    for batch in batches:
        h = batch.column("h").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        seen = seen or batch.num_rows > 0
    if seen:
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())})


def marks_of(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the column h: one table of fixed size, which only saves work."""
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in ids.mapInArrow(_mark, "bits binary").toLocalIterator():  # a table at a time
        bits |= np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return bits


def is_marked(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return ((table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def gram_entries(met: DataFrame, groups: DataFrame, many: DataFrame) -> DataFrame:
    """(tok, gid, np, earlier, k) of the pairs (tok, gid) in ``met``; ``groups`` has gid, n and prefix, ``many`` gid and many.

    ``np`` is the gram's place in the prefix with the group's set size (p * 2^32 + n), ``k`` the groups of the gram, those of
    several classes counted twice, and ``earlier`` the last grams of the group before this one. Of grams that the same
    groups have, only the first has entries: a pair that shares one of them shares all, and meets at the first.
    """
    same = [F.bit_xor(F.xxhash64("gid")).alias("h1"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("h2")]
    counted = met.join(many, "gid").groupBy("tok").agg(F.sum(F.lit(1) + F.col("many")).alias("k"), F.count(F.lit(1)).alias("groups"), *same)
    kept = counted.groupBy("groups", "h1", "h2").agg(F.min(F.struct("tok", "k")).alias("low")).select("low.tok", "low.k")
    place = F.shiftleft((F.array_position("prefix", F.col("tok")) - 1).cast("long"), 32).bitwiseOR(F.col("n"))
    before = Window.partitionBy("gid").orderBy("tok").rowsBetween(-EARLIER, -1)
    placed = met.join(kept, "tok").join(groups, "gid").select("tok", "gid", place.alias("np"), "k")
    return placed.select("tok", "gid", "np", F.collect_list("tok").over(before).alias("earlier"), "k")


def first_meeting(x: str, y: str) -> Column:
    """No gram that both entries carry lies before theirs; a pair with such a one meets there."""
    return ~F.arrays_overlap(x, y)


def forget(spark: SparkSession) -> None:
    """Lets the driver notice that shuffles of finished steps are unused, so that their files go from the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sets(n: int, marks):
    """(cid, grams) of the texts whose id hash is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            keep = is_marked(batch.column("h").to_numpy(), table)
            for part in W.slices(batch.filter(pa.array(keep)), "text"):
                sets = [s for s in W.gram_sets(*W.strings(part.column("text")), n) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cid", "grams"]
                )

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): documents link when ``den * |A & B| >= num * |A | B|``.

    Sets hold distinct n-grams of lower-cased words (runs of anything but ASCII white space); a text of
    fewer words is one gram. ``component_id`` is the smallest id reachable by links. Nulls, empty and blank
    texts have no grams and link with nothing. Repeated rows stay; rows of one id with different texts
    are linked as the documents they are. Rows with a null id get their set size, take no part in the
    links of others and have a null component. Grams and classes are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(gram_classes(texts.select("text"), n))
    id_type = docs.schema[id_col].dataType
    out = f"id {id_type.simpleString()}, n long, cid long, gid long, prefix array<long>"
    rows = cut(texts.mapInArrow(_prefixes(n, num, den, classes, SKETCH_BITS), out), "zstd")

    known = rows.filter("id is not null and cid is not null")
    member = cut(known.groupBy("cid").agg(F.min("id").alias("low"), F.first("gid").alias("gid")))  # one row a class

    # n-grams that two groups have: most have one only, so they travel once, with nothing but their group
    seen = known.select("gid", F.explode("prefix").alias("tok")).repartition("tok")
    shared = seen.groupBy("tok").agg(F.min("gid").alias("g1"), F.max("gid").alias("g2")).filter("g1 <> g2").select("tok")
    met = cut(seen.join(shared, "tok").distinct(), "zstd")
    del seen, shared
    forget(spark)

    # those groups with their prefixes; others can't link to any group
    table = spark.sparkContext.broadcast(marks_of(met.select(F.xxhash64("gid").alias("h")).distinct()))
    may_meet = F.pandas_udf(lambda h: pd.Series(is_marked(h.to_numpy(), table.value)), "boolean")
    shown = known.filter("prefix is not null").select("gid", "n", "prefix", F.xxhash64("gid").alias("h")).filter(may_meet("h"))
    groups = shown.join(met.select("gid").distinct(), "gid", "left_semi").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = cut(groups, "zstd")
    many = member.groupBy("gid").agg((F.min("cid") != F.max("cid")).cast("int").alias("many"))
    entries = cut(gram_entries(met, groups, many), "zstd")
    del met, shown, many
    forget(spark)

    def fits(x, y):
        """Sizes and places leave room for enough common grams."""
        size = (1 << 32) - 1
        a, b = F.col(x).bitwiseAND(size), F.col(y).bitwiseAND(size)
        p, q = F.shiftright(x, 32), F.shiftright(y, 32)
        return (F.least(a, b) * den >= F.greatest(a, b) * num) & (F.least(a - p, b - q) * (den + num) >= (a + b) * num)

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs of groups (x, y) whose prefixes leave room for enough common grams: up to the end of the
        shorter prefix both are known, so a gram there that the other lacks is missing for good."""
        x = groups.select(F.col("gid").alias("x"), F.col("n").alias("nx"), F.col("prefix").alias("px"))
        y = groups.select(F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("prefix").alias("py"))
        both = pairs.join(x, "x").join(y, "y").withColumn("end", F.least(F.element_at("px", -1), F.element_at("py", -1)))
        lacks_x = F.size(F.array_except(F.filter("px", lambda g: g <= F.col("end")), "py"))
        lacks_y = F.size(F.array_except(F.filter("py", lambda g: g <= F.col("end")), "px"))
        total = (F.col("nx") + F.col("ny")) * num
        enough = ((F.col("nx") - lacks_x) * (den + num) >= total) & ((F.col("ny") - lacks_y) * (den + num) >= total)
        return both.filter(enough).select("x", "y")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link, by their whole sets."""
        pairs = cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        marks = spark.sparkContext.broadcast(marks_of(member.join(wanted, "cid").select(F.xxhash64("low").alias("h"))))
        sets = texts.select(F.xxhash64("id").alias("h"), "text").mapInArrow(_sets(n, marks), "cid long, grams array<long>")
        sets = sets.dropDuplicates(["cid"])
        a, b = sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
        common = F.size(F.array_intersect("ga", "gb"))
        enough = common * (den + num) >= (F.size("ga") + F.size("gb")) * num
        return pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b")

    # the hub of each gram, and the first class of each group
    head = member.groupBy("gid").agg(F.min("cid").alias("head"))
    hubs = entries.groupBy("tok").agg(F.min(F.struct("np", "gid")).alias("hub")).select("tok", F.col("hub.gid").alias("h"), F.col("hub.np").alias("hnp"))
    near = entries.join(hubs, "tok").filter("gid <> h").filter(fits("np", "hnp")).select(F.col("gid").alias("x"), F.col("h").alias("y")).distinct()
    near = plausible(near).select(F.col("x").alias("gid"), F.col("y").alias("h"))
    star = near.join(head.select(F.col("gid").alias("h"), F.col("head").alias("a")), "h").join(member.select("gid", F.col("cid").alias("b")), "gid")
    own = member.join(head, "gid").filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    first = cut(linked(star.select("a", "b").union(own).distinct()))
    del near, star
    forget(spark)
    roots = cut(components(first))
    forget(spark)

    # what is left: pairs of groups with classes in different components
    placed = member.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "gid", F.coalesce("root", "cid").alias("root"))
    span = placed.groupBy("gid").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    left = entries.filter("k > 2").drop("k").join(span, "gid")  # two classes have met in the hub round
    open_toks = left.groupBy("tok").agg(F.min("r1").alias("m1"), F.max("r2").alias("m2")).filter("m1 <> m2").select("tok")
    left = left.join(open_toks, "tok")
    x = left.select("tok", *[F.col(c).alias(f"{c}_x") for c in ("gid", "np", "earlier", "r1", "r2")])
    y = left.select("tok", *[F.col(c).alias(f"{c}_y") for c in ("gid", "np", "earlier", "r1", "r2")])
    one_root = (F.col("r1_x") == F.col("r2_x")) & (F.col("r1_y") == F.col("r2_y")) & (F.col("r1_x") == F.col("r1_y"))
    pairs = x.join(y, (x.tok == y.tok) & (F.col("gid_x") < F.col("gid_y")) & fits("np_x", "np_y") & ~one_root & first_meeting("earlier_x", "earlier_y"))
    pairs = plausible(pairs.select(F.col("gid_x").alias("x"), F.col("gid_y").alias("y")).distinct())
    pairs = pairs.select(F.col("x").alias("gid_x"), F.col("y").alias("gid_y"))
    u = placed.select(F.col("gid").alias("gid_x"), F.col("cid").alias("a"), F.col("root").alias("ra"))
    v = placed.select(F.col("gid").alias("gid_y"), F.col("cid").alias("b"), F.col("root").alias("rb"))
    across = pairs.join(u, "gid_x").join(v, "gid_y").filter("ra <> rb").select("a", "b")
    mixed = span.filter("r1 <> r2").select("gid")
    within = u.join(mixed, u.gid_x == mixed.gid).drop("gid").join(v, F.col("gid_x") == F.col("gid_y")).filter("a < b and ra <> rb").select("a", "b")
    checked = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    forget(spark)
    more = cut(linked(across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")))
    del pairs, across, within, left, x, y
    forget(spark)
    roots = components(first.union(more))
    forget(spark)

    # smallest id of each component, back to every row
    home = member.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "low", F.coalesce("root", "cid").alias("root"))
    lowest = home.groupBy("root").agg(F.min("low").alias("component_id"))
    home = home.join(lowest, "root").select("cid", "component_id")
    named = rows.select("id", "n", "cid").join(home, "cid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
    )
    return named
