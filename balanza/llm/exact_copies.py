"""Exact duplicates: counting quotient filters over fingerprints, then a comparison of whole texts.

1. Texts are normalised (each run of ASCII white space becomes one space) and get a fingerprint of 48 bits.
2. Every task builds counting quotient filters of its fingerprints, one for each segment of the fingerprint
   range. A filter keeps sorted remainders, so it gives back its fingerprints and counts without loss, and
   filters of one segment merge by merging these.
3. Fingerprints with a count above one set bits in a table of fixed size, of which each segment fills its own
   slice. Rows whose bit is clear are alone: they are done without their text leaving the task.
4. The other rows are grouped by fingerprint and whole text, which is the verification by bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from balanza.session import cut

#: Bits of a fingerprint.
BITS = 48
#: Fingerprints of a segment, as a power of two: a merged filter has some 7 MB.
SEGMENT_BITS = 20
#: Bits of the table that routes rows, as a power of two: 4 MB in each task. It saves work only.
ROUTE_BITS = 25
#: Distinct fingerprints that a task holds before it writes its filters.
HELD = 1 << 21


def pack_filter(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of ascending distinct fingerprints of ``bits`` bits.

    Quotients are the high bits: one flag says whether a quotient has a run, one flag for each remainder whether
    its run ends there. Remainders follow in order, in whole bytes. A third flag marks counts above one, which
    follow as 64-bit numbers.
    """
    n = len(prints)
    q = min(bits, max(n - 1, 0).bit_length())
    r = bits - q
    quotient = (prints >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    ends = np.ones(n, dtype=bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    width = (r + 7) // 8
    rest = (prints & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = counts > 1
    return b"".join([
        struct.pack("<BBQ", bits, q, n), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(many).tobytes(),
        np.ascontiguousarray(rest).tobytes(), counts[many].astype("<u8").tobytes(),
    ])


def unpack_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, ascending, and their counts."""
    bits, q, n = struct.unpack_from("<BBQ", data)
    r = bits - q
    at = struct.calcsize("<BBQ")

    def flags(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
        at += len(part)
        return np.unpackbits(part, count=size).astype(bool)

    occupied, ends, many = flags(1 << q), flags(n), flags(n)
    width = (r + 7) // 8
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    run = np.cumsum(ends) - ends
    prints = rest.view("<u8").reshape(n).astype(np.uint64)
    if n:
        prints = prints | (np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(r))
    counts = np.ones(n, dtype=np.uint64)
    counts[many] = np.frombuffer(data, "<u8", int(many.sum()), at)
    return prints, counts


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of several filters merged, counts of equal ones added."""
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
    return prints[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _segments(prints: np.ndarray, counts: np.ndarray, seg_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    seg = (prints >> np.uint64(BITS - seg_bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(seg)), strict=True):
        yield int(seg[a]), prints[a:b] & np.uint64((1 << (BITS - seg_bits)) - 1), counts[a:b]


def _filter_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"seg": pa.array([s for s, _ in rows], pa.int32()), "filter": pa.array([f for _, f in rows], pa.binary())})


def _build(seg_bits: int):
    """Fingerprints of a task as filters of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

        def written() -> pa.RecordBatch:
            return _filter_rows([(s, pack_filter(p, c, BITS - seg_bits)) for s, p, c in _segments(*held, seg_bits)])

        for batch in batches:
            new, counts = np.unique(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.uint64), return_counts=True)
            held = merge_counts([held, (new, counts.astype(np.uint64))])
            if len(held[0]) >= HELD:
                yield written()
                held = (held[0][:0], held[1][:0])
        if len(held[0]):
            yield written()

    return run


def _merge(seg_bits: int):
    """Filters of the same segments merged; a task holds the segments it was dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            parts: dict[int, list] = {}
            for seg, data in zip(batch.column("seg").to_pylist(), batch.column("filter"), strict=True):
                parts.setdefault(seg, []).append(unpack_filter(data.as_py()))
            for seg, some in parts.items():
                total[seg] = merge_counts(some + [total[seg]] if seg in total else some)
        for seg, (prints, counts) in total.items():
            yield _filter_rows([(seg, pack_filter(prints, counts, BITS - seg_bits))])

    return run


def _slices(seg_bits: int):
    """The bits of the fingerprints that occur more than once, a slice of the routing table for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, data in zip(batch.column("seg").to_pylist(), batch.column("filter"), strict=True):
                prints, counts = unpack_filter(data.as_py())
                bits = np.zeros(1 << (ROUTE_BITS - seg_bits), dtype=bool)
                bits[(prints[counts > 1] >> np.uint64(BITS - ROUTE_BITS)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    return run


def merged_filters(prints: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(seg, filter) of all fingerprints (column fp), written once, and the bits that number the segments."""
    seg_bits = min(max(0, (max(rows, 1) - 1).bit_length() - SEGMENT_BITS), ROUTE_BITS - 3)
    schema = "seg int, filter binary"
    built = prints.select("fp").mapInArrow(_build(seg_bits), schema)
    return cut(built.repartition(1 << seg_bits, "seg").mapInArrow(_merge(seg_bits), schema)), seg_bits


def routing_table(filters: DataFrame, seg_bits: int) -> np.ndarray:
    """The bit table of repeated fingerprints: 4 MB, whatever the number of rows."""
    table = np.zeros(1 << (ROUTE_BITS - 3), dtype=np.uint8)
    width = len(table) >> seg_bits
    for row in filters.mapInArrow(_slices(seg_bits), "seg int, bits binary").toLocalIterator():
        table[row.seg * width : (row.seg + 1) * width] = np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return table


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row; with ``carry`` also ``row``, a struct of all its columns.

    Rows are copies when their texts have the same bytes after each run of ASCII white space became one space; a
    null text counts as empty. Of copies the row with the smallest id stays, null ids last; of several rows with
    that id just one stays, whichever is read first. A blank text is one space and no copy of an empty one. An
    empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    # runs of two or more, or one that is not a space: a single space is left as it is
    norm = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), norm.alias("norm"), *row)
    texts = texts.withColumn("fp", F.shiftrightunsigned(F.xxhash64("norm"), 64 - BITS))
    filters, seg_bits = merged_filters(texts, docs.count())
    table = spark.sparkContext.broadcast(routing_table(filters, seg_bits))

    @F.pandas_udf("boolean")
    def repeated(fp: pd.Series) -> pd.Series:
        place = fp.to_numpy() >> (BITS - ROUTE_BITS)
        return pd.Series((table.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool))

    rest = ["row"] if carry else []
    rows = texts.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("routed", repeated("fp"))
    rows = rows.select("id", F.monotonically_increasing_id().alias("rid"), "fp", "text_sha256", "routed", F.when(F.col("routed"), F.col("norm")).alias("norm"), *rest)
    rows = cut(rows, "zstd")

    alone = rows.filter("not routed").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *rest)
    several = rows.filter("routed")
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("low")
    classes = several.groupBy("fp", "norm").agg(low, F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("fp", F.sha2("norm", 256).alias("text_sha256"), F.col("low.id").alias("keep_id"), F.col("low.rid").alias("keep_rid"), "group_size")
    named = several.drop("norm").join(classes, ["fp", "text_sha256"]).select("id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", *rest)
    return alone.unionByName(named)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_copies(docs, id_col, text_col, carry=True).filter("kept").select("row.*")
