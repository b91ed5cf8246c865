"""Token-id files: texts encoded with a tokenizer file, entropy-coded by static rANS, read back in parallel.

A file holds whole documents in ascending id order. Its layout:

    magic "RANSTOK1", u32 length of the header, header (JSON), sections
    index      Arrow IPC stream (id, n_tokens, crc32) of its documents, zlib
    symbols    u32 token ids present, ascending, and their u32 frequencies, zlib: one table for all blocks
    checkpoints  for each block: u64 offset, u64 first token, u32 tokens, u32 crc32 of its token ids
    blocks     lane states (u64), words per lane (u32), words (u32)

All numbers are little-endian. A block decodes alone, so a reader may take any range of tokens.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from balanza.llm import rans, words as W
from balanza.llm.files import attempt, new_folder, one_task_each, open_folder, read_bytes
from balanza.session import cut

MAGIC = b"RANSTOK1"
FILE_TOKENS = 1 << 21
CHECKPOINT = np.dtype([("offset", "<u8"), ("first", "<u8"), ("n", "<u4"), ("crc", "<u4")])

# Byte classes for cutting texts into pieces that encode alone: 0 white space, 1 ASCII letters, 2 ASCII
# punctuation that ends and begins pre-tokens, 5 the rest. A cut lies at white space and between 1 and 2.
# Apostrophes begin contractions, and < | > make up special tokens: these belong to the rest.
_KIND = np.full(256, 5, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 2
_PLAIN = _KIND.copy()
_PLAIN[_PLAIN > 0] = 5


# What a tokenizer file must say for its texts to be cut into pieces.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def cuts_into_pieces(spec: dict) -> bool:
    """Whether a tokenizer file (as JSON) lower-cases, drops white space, and splits words, digits and punctuation apart."""
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(before) == 2 and before[0].get("type") == "Split" and before[0].get("pattern") == {"Regex": _SPLIT} and before[0].get("behavior") == "Removed" and before[0].get("invert")
    return bool(
        split and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and not before[1].get("use_regex") and spec.get("normalizer") == _NORMALIZER
        and spec.get("model", {}).get("type") == "BPE" and not spec.get("truncation") and not spec.get("padding")
    )


class PieceEncoder:
    """Encodes texts with a word tokenizer, each distinct piece once while it stays in the cache.

    Exact for tokenizers that split at white space and between letters and punctuation before merging;
    texts with a final-sigma candidate are cut at white space only, as lower-casing looks across pieces.
    Files that do not say that they split so encode whole texts.
    """

    SLOTS = 1 << 20
    ENTRIES = 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_pieces = cuts_into_pieces(json.load(f))
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(self.SLOTS, dtype=np.uint64)
        self.where = np.zeros(self.SLOTS, dtype=np.int32)
        self.length, self.offset = np.zeros(1, np.int32), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of new pieces."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: list[list[int]] = []
        for i in range(0, len(texts), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], dtype=np.int32)
        first = len(self.length)
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], dtype=np.int32)])
        return np.arange(first, first + len(ids), dtype=np.int32)

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        keys = W.span_hashes(data, starts, ends, lower) ^ np.uint64(0 if lower else 0xA5A5)
        keys[keys == 0] = 1
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = self.where[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            made = self._learn(data, starts[miss[at]], ends[miss[at]])
            entry[miss] = made[back]
            slot = (new & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.where[slot] = new, made
            # two new keys may share a slot: only the last stays, and must have its own entry
        return entry

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and the offsets of the rows in them."""
        if not self.by_pieces:
            return self._whole(data, at)
        if len(self.length) > self.ENTRIES:
            self.reset()
        raw = data.tobytes()
        kind = (_PLAIN if b"\xce\xa3" in raw else _KIND)[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        change = np.ones(len(data), dtype=bool)
        if len(data):
            change[1:] = (kind[:-1] == 0) | (kind[1:] * kind[:-1] == 2) | edge[1:-1]
        starts = np.flatnonzero(change & (kind != 0))
        stop = np.ones(len(data), dtype=bool)
        if len(data):
            stop[:-1] = change[1:] | (kind[1:] == 0)
        ends = np.flatnonzero(stop & (kind != 0)) + 1
        entry = self._entries(data, starts, ends, b"<|" not in raw) if len(starts) else np.zeros(0, np.int32)
        size = self.length[entry].astype(np.int64)
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        pick = np.repeat(self.offset[entry] - (done - size), size) + np.arange(total)
        return self.flat[pick], np.concatenate([[0], done])[np.searchsorted(starts, at)]


    def _whole(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([t for x in ids for t in x], dtype=np.int32), np.cumsum([0, *(len(x) for x in ids)])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def pack(ids: np.ndarray, index: pa.RecordBatch, block: int = rans.BLOCK, lanes: int = rans.LANES) -> bytes:
    """One file."""
    symbols, coded, counts = np.unique(ids, return_inverse=True, return_counts=True)
    table = rans.Table(symbols, rans.quantize(counts, rans.table_bits(len(symbols))))
    blocks = rans.encode(coded, table, block, lanes)
    bodies = [s.astype("<u8").tobytes() + w.astype("<u4").tobytes() + x.astype("<u4").tobytes() for s, w, x in blocks]
    marks = np.zeros(len(blocks), dtype=CHECKPOINT)
    at = 0
    for i, body in enumerate(bodies):
        part = ids[i * block : (i + 1) * block]
        marks[i] = (at, i * block, len(part), zlib.crc32(part.astype("<u4").tobytes()))
        at += len(body)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as writer:
        writer.write_batch(index)
    sections = [
        zlib.compress(sink.getvalue().to_pybytes(), 6),
        zlib.compress(np.concatenate([table.symbols, table.freq]).astype("<u4").tobytes(), 6),
        marks.tobytes(),
    ]
    header = json.dumps({
        "tokens": len(ids), "documents": index.num_rows, "block": block, "lanes": lanes, "symbols": len(symbols),
        "sections": [len(s) for s in sections], "crc": [zlib.crc32(s) for s in sections],
    }).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections, *bodies])


class TokenFile:
    """A file in memory; blocks are decoded on demand and checked."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", raw, 8)
        self.header = json.loads(raw[12 : 12 + size])
        at, sections = 12 + size, []
        for n, crc in zip(self.header["sections"], self.header["crc"], strict=True):
            sections.append(raw[at : at + n])
            if zlib.crc32(sections[-1]) != crc:
                raise ValueError("damaged section")
            at += n
        self.raw, self.base = raw, at
        self.index = pa.Table.from_batches(list(pa.ipc.open_stream(zlib.decompress(sections[0]))))
        both = np.frombuffer(zlib.decompress(sections[1]), "<u4")
        self.table = rans.Table(both[: len(both) // 2], both[len(both) // 2 :])
        self.marks = np.frombuffer(sections[2], CHECKPOINT)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Token ids of blocks first … last - 1."""
        lanes, parts = self.header["lanes"], []
        for mark in self.marks[first:last]:
            at = self.base + int(mark["offset"])
            states = np.frombuffer(self.raw, "<u8", lanes, at)
            counts = np.frombuffer(self.raw, "<u4", lanes, at + 8 * lanes)
            parts.append((states, counts, np.frombuffer(self.raw, "<u4", int(counts.sum()), at + 12 * lanes), int(mark["n"])))
        out = [self.table.symbols[x] for x in rans.decode(parts, self.table, self.header["block"], lanes)]
        for x, mark in zip(out, self.marks[first:last], strict=True):
            if zlib.crc32(x.astype("<u4").tobytes()) != mark["crc"]:
                raise ValueError(f"block at token {mark['first']} is damaged")
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def span(self, begin: int, end: int) -> np.ndarray:
        """Token ids begin … end - 1 of the file, from the blocks that hold them alone."""
        block = self.header["block"]
        return self.blocks(begin // block, -(-end // block))[begin % block :][: max(0, end - begin)]


def _write(folder: str, tokenizer: str, end_id: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        part, tries = attempt()
        fs, root = open_folder(folder)
        held, names, sizes, crcs, count, serial = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, sizes, crcs, count, serial
            index = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "n_tokens", "crc32"])
            body = pack(np.concatenate(held), index)
            path = f"{root}/part-{part:06d}-{serial:05d}-{tries}.tok"
            with fs.open_output_stream(path) as out:
                out.write(body)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "serial": pa.array([serial], pa.int32()), "path": [f"{folder}/{path.rsplit('/', 1)[1]}"],
                "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([count], pa.int64()), "n_bytes": pa.array([len(body)], pa.int64()),
            })
            held, names, sizes, crcs, count = [], [], [], [], 0
            serial += 1
            W.release()
            return row

        for batch in batches:
            for rows in W.slices(batch, "text"):
                ids, at = code.encode(*W.strings(rows.column("text")))
                ends = at[1:] + np.arange(rows.num_rows)
                full = np.full(len(ids) + rows.num_rows, end_id, dtype=np.uint32)
                keep = np.ones(len(full), dtype=bool)
                keep[ends] = False
                full[keep] = ids
                raw, begin = memoryview(full.astype("<u4").tobytes()), 0
                for e in ends.tolist():
                    crcs.append(zlib.crc32(raw[4 * begin : 4 * e + 4]))
                    sizes.append(e + 1 - begin)
                    begin = e + 1
                held.append(full)
                names.append(rows.column("id"))
                count += len(full)
                if count >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files in ascending id order and returns their manifest, one row a file.

    Columns: part, serial (files in order), path, n_docs, n_tokens, n_bytes and start (tokens of all files
    before). Rows are dealt out by ranges of (id, text hash), so a repeated id does not gather in one
    task; null ids come first. A null or empty text is its end id alone. No rows give no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    schema = "part int, serial int, path string, n_docs long, n_tokens long, n_bytes long"
    made = cut(rows.mapInArrow(_write(new_folder(spark, "tokens"), tokenizer, end_id, file_tokens), schema))
    # running sum in two steps: inside runs of a thousand parts, then over the runs
    run = F.floor(F.col("part") / 1000)
    sums = made.groupBy(run.alias("run")).agg(F.sum("n_tokens").alias("s"))
    before = sums.select("run", (F.sum("s").over(Window.orderBy("run")) - F.col("s")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("run").orderBy("part", "serial")) - F.col("n_tokens")
    return made.withColumn("run", run).withColumn("inside", inside).join(before, "run").select(
        "part", "serial", "path", "n_docs", "n_tokens", "n_bytes", (F.col("base") + F.col("inside")).alias("start")
    )


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(read_bytes(path))
                ids = file.blocks(0, len(file.marks)).astype("<u4")
                sizes = file.index.column("n_tokens").to_numpy()
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if crc != file.index.column("crc32").to_pylist():
                    raise ValueError(f"{path}: a document's ids differ from what was written")
                columns = {"id": file.index.column("id").combine_chunks(), "start": pa.array(at[:-1] + start, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=10_000)
                del file, ids, raw
                W.release()

    return run


def read_token_files(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files and checked."""
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return one_task_each(cut(manifest.select("path", "start"))).mapInArrow(_read(with_ids), schema)
