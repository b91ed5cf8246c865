"""Benchmark decontamination by winnowing.

A text's fingerprints are the k-gram hashes that are the least of some window of w consecutive k-grams, all
ties kept. Two texts that share k + w - 1 words therefore share a fingerprint inside that span. Documents
and benchmark items meet on fingerprints; a hit is extended over the words around it, and counts where the
equal run reaches a whole window of the item. Items shorter than a window are one window of their own length,
found by their own hash at every position.

Fingerprints that no item has are dropped where they are made, by a bit table of fixed size that only saves
work; the join decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W
from balanza.session import cut

#: Bits of the filter table, as a power of two: 2 MB in each task, whatever the number of items.
FILTER_BITS = 24
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over x[i : i + width], for each i that has them all."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = of(out[: len(out) - step], out[step:])
        done += step
    return out


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of all rows; ``first`` has each row's first word and the end.

    Only positions whose k-gram lies in its row count. Windows over a row's border may add some, never
    remove any.
    """
    grams = W.grams(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    inner = np.ones(len(grams), dtype=bool)
    for back in range(1, k):  # k-grams that begin so many words before a border leave their row
        at = first[1:-1] - back
        inner[at[(at >= 0) & (at < len(grams))]] = False
    grams = np.where(inner, grams, _LAST)
    padded = np.concatenate([np.full(w - 1, _LAST), grams, np.full(w - 1, _LAST)])
    least = _slide(padded, w, np.minimum)
    chosen = np.flatnonzero((_slide(least, w, np.maximum) == grams) & inner)
    return chosen, grams[chosen]


def _near(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, left: int, size: int, pad: int) -> np.ndarray:
    """The words at - left … at - left + size - 1 of each position's row; ``pad`` where there are none."""
    row = np.searchsorted(first, at, side="right") - 1
    grid = at[:, None] - left + np.arange(size)
    good = (grid >= first[row][:, None]) & (grid < first[row + 1][:, None])
    return np.where(good, hashes[np.clip(grid, 0, max(0, len(hashes) - 1))], np.uint64(pad))


def _lists(grid: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1) * grid.shape[1], pa.int32()), pa.array(grid.ravel().view(np.int64)))


def _words(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = W.strings(rows.column("text"))
    starts, ends, first = W.word_bounds(data, at, W.ALNUM)
    return W.span_hashes(data, starts, ends), first


def _item_prints(window: int, k: int):
    """(item, k, h, near): fingerprints of items of at least a window, whole hashes of shorter ones."""
    w = window - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "text"):
                hashes, first = _words(rows)
                size = np.diff(first)
                at, h = fingerprints(hashes, first, k, w)
                of = np.searchsorted(first, at, side="right") - 1
                long = size[of] >= window
                at, h, length = at[long], h[long], np.full(int(long.sum()), k)
                short = np.flatnonzero((size > 0) & (size < window))
                at = np.concatenate([at, first[short]])
                h = np.concatenate([h, *[W.grams(hashes[first[i] : first[i + 1]], int(size[i])) for i in short]])
                length = np.concatenate([length, -size[short]])
                of = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column("item").take(pa.array(of)), pa.array(length, pa.int32()), pa.array(h.view(np.int64)), _lists(_near(hashes, first, at, window - k, 2 * window - k, 1))],
                    names=["item", "k", "h", "near"],
                )

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, lengths = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8), set()
    for batch in batches:
        h = batch.column("h").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)))
        lengths |= set(np.unique(batch.column("k").to_numpy()).tolist())
    if lengths:
        yield pa.RecordBatch.from_pydict({"bits": pa.array([table.tobytes()], pa.binary()), "lengths": pa.array([sorted(lengths)], pa.list_(pa.int32()))})


def _document_prints(window: int, k: int, shared):
    w, left, size = window - k + 1, window - k, 2 * window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shared.value

        def known(h: np.ndarray) -> np.ndarray:
            cell = h & np.uint64((1 << FILTER_BITS) - 1)
            return np.flatnonzero((bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)

        for batch in batches:
            for rows in W.slices(batch, "text"):
                hashes, first = _words(rows)
                found = []
                if k in lengths:
                    at, h = fingerprints(hashes, first, k, w)
                    keep = known(h)
                    found.append((at[keep], h[keep], np.full(len(keep), k)))
                for m in (-x for x in lengths if x < 0):
                    h = W.grams(hashes, m)
                    at = known(h)
                    row = np.searchsorted(first, at, side="right") - 1
                    at = at[at + m <= first[row + 1]]
                    found.append((at, h[at], np.full(len(at), -m)))
                at, h, length = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
                at = at.astype(np.int64)
                of = np.searchsorted(first, at, side="right") - 1
                order = np.argsort(of, kind="stable")
                at, h, length, of = at[order], h[order].astype(np.uint64), length[order], of[order]
                hits = pa.StructArray.from_arrays(
                    [pa.array(at - first[of], pa.int64()), pa.array(length, pa.int32()), pa.array(h.view(np.int64)), _lists(_near(hashes, first, at, left, size, 0))],
                    names=["p", "k", "h", "near"],
                )
                data, offsets = W.strings(rows.column("text"))
                raw = memoryview(data)
                keys = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                spots = pa.array(np.searchsorted(of, np.arange(rows.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(keys, pa.binary()), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(spots, hits)],
                    names=["id", "key", "n_words", "hits"],
                )

    return run


def _extend(window: int, k: int):
    """The equal run around each hit; kept where it holds a whole window of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, size = window - k, 2 * window - k
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("near").flatten().to_numpy().reshape(-1, size)
            b = batch.column("item_near").flatten().to_numpy().reshape(-1, size)
            same = a == b
            before = np.cumprod(same[:, :left][:, ::-1], axis=1).sum(axis=1)
            after = np.cumprod(same[:, left:], axis=1).sum(axis=1)
            short = batch.column("k").to_numpy() < 0
            m = np.where(short, -batch.column("k").to_numpy(), window)
            begin = np.where(short, 0, before)
            reach = np.where(short, np.minimum(after, m), after)
            good = begin + reach >= m
            p = batch.column("p").to_numpy()
            out = pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("item"), pa.array(p - begin, pa.int64()), pa.array(p + reach, pa.int64())],
                names=["key", "item", "begin", "end"],
            )
            yield out.filter(pa.array(good))

    return run


def winnow_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, n_words) and the spans (key, item, begin, end) of words that items share with them.

    ``key`` stands for the text: rows of equal text share their spans. Words are lower-cased runs of ASCII
    letters, digits and non-ASCII characters. Nulls and texts without words have no spans; items without
    words match nothing. Item ids are compared as strings, a null id as the empty string.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    spark = docs.sparkSession
    needles = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    prints = cut(needles.mapInArrow(_item_prints(window, k), "item string, k int, h long, near array<long>").distinct())
    bits, lengths = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8), set()
    for row in prints.select("h", "k").mapInArrow(_bits, "bits binary, lengths array<int>").toLocalIterator():
        bits |= np.frombuffer(row.bits, dtype=np.uint8)  # one table of fixed size at a time
        lengths |= set(row.lengths)
    shared = spark.sparkContext.broadcast((bits, sorted(lengths)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key binary, n_words long, hits array<struct<p:long,k:int,h:long,near:array<long>>>"
    seen = cut(texts.mapInArrow(_document_prints(window, k, shared), schema))
    hits = seen.filter(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits")).select("key", F.inline("hits"))
    joined = hits.join(prints.withColumnRenamed("near", "item_near"), ["h", "k"]).select("key", "item", "p", "k", "near", "item_near")
    spans = joined.mapInArrow(_extend(window, k), "key binary, item string, begin long, end long").distinct()
    return seen.select("id", "key", "n_words"), cut(spans)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, share: int = 20) -> DataFrame:
    """For every document row (id, n_words, n_hit, n_items, items_sha256, contaminated).

    A word is hit when it lies in an occurrence of an item's window; a document is contaminated when
    it has hit words and ``share * n_hit >= n_words``. The digest is of the item ids sorted as strings and
    joined by commas, of the empty string where there are none.
    """
    base, spans = winnow_matches(docs, items, id_col, text_col, item_col, item_text, window, k)
    # the union of the spans of a text: merge runs that touch, then add up their lengths
    spots = spans.select("key", F.explode(F.sequence("begin", F.col("end") - 1)).alias("w")).distinct()
    n_hit = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    names = spans.select("key", "item").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256")
    )
    zero = F.lit(0).cast("long")
    marks = cut(n_hit.join(names, "key"))  # a table of its own, so that a key with many copies can be split in the join
    out = base.join(marks, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
