"""Two tokenizers aligned over a corpus: where their tokens end together, and which ids are linked.

A task works on Arrow columns of many documents at once:

1. Texts are cut at blanks into chunks that encode alone in both tokenizers; each distinct chunk is encoded once
   while it stays in the worker's cache. The ids of a document are a list column.
2. Flattened lists, parent indices and segmented cumulative sums of byte lengths give every token its end. Documents
   whose joined bytes are not their text lose their tokens.
3. A hash join on (document, end) finds the ends that both have; running sums of these number the groups.
4. Tokens of a group are linked with one another. A document's pairs are counted, and ``Table.group_by`` counts for
   each block of documents how many hold a pair.

Spark adds the blocks' counts up, marks the best pairs of each id of A, and brings counts back to the blocks by
a join on the pairs of a block, so that a pair travels once a block and not once a document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W
from balanza.session import cut

#: Pairs of documents that a block holds before it is closed; a document is never divided.
BLOCK_PAIRS = 1 << 20
#: Links that are expanded at once.
LINKS = 1 << 20
#: Groups with more links than this are first reduced to distinct ids.
LARGE_GROUP = 256
#: Text bytes that are aligned at once.
SLICE = 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; it encodes what it is given, special tokens as plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        table = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes = pa.array(table, pa.binary())

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, each with its leading blank."""
        out: list[list[int]] = []
        for i in range(0, len(chunks), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(chunks[i : i + 4096], add_special_tokens=False)]
        return out


class Pieces:
    """A sentencepiece model with byte fallback; the model adds the leading blank itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that cross blanks can't be encoded by chunks")
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode([c[1:] for c in chunks], num_threads=1)


# bytes after which a blank can't be part of a longer run of white space: printable ASCII, and non-ASCII characters but
# those of lead bytes that white space has
_OPENS = np.zeros(256, dtype=bool)
_OPENS[0x21:0x7F] = True
_OPENS[0x80:] = True
_OPENS[[0xC2, 0xE1, 0xE2, 0xE3]] = False


class Pair:
    """Both tokenizers with one cache of chunks."""

    SLOTS = 1 << 21
    ENTRIES = 1 << 20

    def __init__(self, path_a: str, path_b: str):
        self.sides = (ByteLevel(path_a), Pieces(path_b))
        self.lengths = [pc.binary_length(s.bytes).to_numpy().astype(np.int64) for s in self.sides]
        self.reset()

    def reset(self) -> None:
        self.keys, self.where = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.size = [np.zeros(1, np.int64) for _ in self.sides]
        self.offset = [np.zeros(1, np.int64) for _ in self.sides]
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        chunks = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        first = len(self.size[0])
        for k, side in enumerate(self.sides):
            ids = side.encode(chunks)
            size = np.array([len(x) for x in ids], dtype=np.int64)
            self.offset[k] = np.concatenate([self.offset[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.size[k] = np.concatenate([self.size[k], size])
            self.flat[k] = np.concatenate([self.flat[k], np.array([t for x in ids for t in x], dtype=np.int32)])
        return np.arange(first, first + len(chunks), dtype=np.int32)

    def encode(self, spaced: pa.Array) -> list[pa.ListArray]:
        """Ids of both sides for texts that begin with the added blank."""
        if len(self.size[0]) > self.ENTRIES:
            self.reset()
        data, at = W.strings(spaced)
        opens = np.zeros(len(data), dtype=bool)
        opens[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _OPENS[data[2:]]
        opens[at[1:-1] - 1] = False  # a text's last blank has the next text's first byte after it
        opens[at[:-1]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        keys = W.span_hashes(data, starts, ends, lower=False)
        keys[keys == 0] = 1
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = self.where[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            made = self._learn(data.tobytes(), starts[miss[first]], ends[miss[first]])
            entry[miss] = made[back]
            place = (new & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[place], self.where[place] = new, made
        rows = np.append(np.searchsorted(starts, at[:-1]), len(starts))
        out = []
        for k in range(2):
            size = self.size[k][entry]
            done = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(self.offset[k][entry] - done[:-1], size) + np.arange(done[-1])
            out.append(pa.ListArray.from_arrays(pa.array(done[rows], pa.int32()), pa.array(self.flat[k][pick], pa.int32())))
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    """One for each worker and pair of files."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def _spells(ids: pa.ListArray, table: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of a row's tokens are its text."""
    joined = table.take(pc.list_flatten(ids))
    raw, ends = W.strings(joined)
    mine = ends[ids.offsets.to_numpy()]
    good = np.diff(mine) == np.diff(at)
    if good.all():
        wrong = np.flatnonzero(raw != data)
    else:  # rows of another length are out; compare the rest
        of = np.repeat(good, np.diff(at))
        own = np.repeat(good, np.diff(mine))
        wrong = np.flatnonzero(of)[raw[own] != data[of]]
    good[np.searchsorted(at, wrong, side="right") - 1] = False
    return good


def _ends(ids: pa.ListArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, their rows, and the byte at which each ends in its row."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pa.array(lengths).take(flat)).to_numpy()
    before = np.concatenate([[0], total])[ids.offsets.to_numpy()[:-1]]
    parent = parent.to_numpy().astype(np.int64)
    return flat.to_numpy(), parent, total - before[parent]


def _common(parent_a: np.ndarray, ends_a: np.ndarray, parent_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the tokens of A and of B that end where the other has an end too, by a join on (row, end)."""
    key = [(p << 40) | e for p, e in ((parent_a, ends_a), (parent_b, ends_b))]
    a = pa.table({"key": key[0], "a": np.arange(len(key[0]))})
    b = pa.table({"key": key[1], "b": np.arange(len(key[1]))})
    both = a.join(b, keys="key", join_type="inner", use_threads=False)
    flags = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    flags[0][both["a"].to_numpy()] = True
    flags[1][both["b"].to_numpy()] = True
    return flags


def _distinct(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) by group; ids of large groups once each."""
    some = large[group]
    t = pa.table({"g": group[some], "i": ids[some]}).group_by(["g", "i"], use_threads=False).aggregate([([], "count_all")])
    g = np.concatenate([group[~some], t["g"].to_numpy()])
    i = np.concatenate([ids[~some], t["i"].to_numpy()])
    n = np.concatenate([np.ones(int((~some).sum()), np.int64), t["count_all"].to_numpy()])
    order = np.argsort(g, kind="stable") if some.any() else slice(None)
    return g[order], i[order], n[order]


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their sums."""
    if not len(keys):
        return keys, times
    if (times == 1).all():
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times[order], first)


def _linked(row_of: np.ndarray, side_a, side_b, groups: int, width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row * span + a * width + b) of all links, ascending, and how often each is linked."""
    (ga, ia, na), (gb, ib, nb) = side_a, side_b
    begin = np.searchsorted(gb, np.arange(groups))
    size = np.diff(np.append(begin, len(gb)))[ga]
    done = np.concatenate([[0], np.cumsum(size)])
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = 0
    while i < len(ga):
        j = max(i + 1, int(np.searchsorted(done, done[i] + LINKS, side="right")) - 1)
        rep = np.repeat(np.arange(i, j), size[i:j])
        other = begin[ga[rep]] + np.arange(done[i], done[j]) - done[rep]
        new = row_of[ga[rep]] * span + ia[rep].astype(np.int64) * width + ib[other]
        more = _added(new, na[rep] * nb[other])
        keys, times = more if not len(keys) else _added(np.concatenate([keys, more[0]]), np.concatenate([times, more[1]]))
        i = j
    return keys, times


def _spelled(strings: pa.Array, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;…`` for all rows in one buffer, and the end of each token's part. ``strings`` has every id
    with a comma, then every id with a bar, then with a semicolon."""
    count_a, count_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    before_b = (np.cumsum(count_b) - count_b)[group_a]
    until_a = np.cumsum(count_a)[group_b]
    what = np.empty(len(a) + len(b), dtype=np.int64)
    what[np.arange(len(a)) + before_b] = a + last_a * size
    what[np.arange(len(b)) + until_a] = b + last_b * (2 * size)
    return W.strings(strings.take(pa.array(what)))


class Aligner:
    """Aligns slices of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = tokenizer_pair(path_a, path_b)
        self.width = len(self.pair.sides[1].bytes)
        self.span = len(self.pair.sides[0].bytes) * self.width
        top = max(len(s.bytes) for s in self.pair.sides)
        self.top = top
        self.strings = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(top)])

    def slice(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Columns for each text, then the texts' pairs: row, pair, times."""
        n = len(texts)
        out: dict = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
        none = np.zeros(0, np.int64)
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        rows = np.flatnonzero(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False))
        if not len(rows):
            return out, none, none, none
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(rows)), " ")
        ids = self.pair.encode(spaced)
        data, at = W.strings(spaced)
        good = _spells(ids[0], self.pair.sides[0].bytes, data, at) & _spells(ids[1], self.pair.sides[1].bytes, data, at)
        rows, ids = rows[good], [x.filter(pa.array(good)) for x in ids]
        if not len(rows):
            return out, none, none, none
        a, row_a, end_a = _ends(ids[0], self.pair.lengths[0])
        b, row_b, end_b = _ends(ids[1], self.pair.lengths[1])
        last_a, last_b = _common(row_a, end_a, row_b, end_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        row_of = row_a[last_a]
        groups = len(row_of)
        links = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups)
        large = links > LARGE_GROUP
        keys, times = _linked(row_of, _distinct(group_a, a, large), _distinct(group_b, b, large), groups, self.width, self.span)
        for name, of, weights in (("n_a", row_a, None), ("n_b", row_b, None), ("n_groups", row_of, None)):
            out[name][rows] = np.bincount(of, weights, minlength=len(rows))
        edge = np.searchsorted(row_of, np.arange(len(rows)))
        out["n_links"][rows] = np.add.reduceat(links, edge)
        raw, ends = _spelled(self.strings, a, b, group_a, group_b, last_a, last_b, self.top)
        raw = raw.tobytes()
        tokens = np.cumsum(out["n_a"][rows] + out["n_b"][rows])
        stop = ends[tokens].tolist()
        for r, begin, end in zip(rows.tolist(), [0, *stop[:-1]], stop, strict=True):
            out["groups_sha256"][r] = hashlib.sha256(raw[begin : end - 1]).hexdigest()
        return out, rows[keys // self.span], keys % self.span, times


_DOC = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _block(block: int, parts: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of one block: its documents, then one row with its pairs and how many of its documents hold each."""
    n = sum(len(ids) for ids, *_ in parts)
    pair = np.concatenate([p for *_, p, _ in parts])
    held = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    known = held["pair"].to_numpy()
    code = np.searchsorted(known, pair).astype(np.int32)
    sizes = np.concatenate([np.bincount(row, minlength=len(ids)) for ids, _, row, _, _ in parts])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    step = np.diff(code, prepend=np.int32(0))
    heads = offset[:-1][sizes > 0]
    step[heads] = code[heads]  # steps within a document
    times = np.concatenate([t for *_, t in parts])
    ids = pa.concat_arrays([i for i, *_ in parts])
    one = {
        "block": pa.array([block] * (n + 1), pa.int64()),
        "id": pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
        **{c: pa.array([*(x for _, out, *_ in parts for x in out[c]), None], schema.field(c).type) for c in _DOC},
        "codes": _lists(offset, step, pa.int32()), "times": _lists(offset, times, pa.int64()),
        "pairs": pa.array([None] * n + [known], pa.list_(pa.int64())), "holders": pa.array([None] * n + [held["count_all"].to_numpy()], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_pydict(one)


def _lists(offset: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The lists of the documents, and an empty one for the block's own row."""
    return pa.ListArray.from_arrays(pa.array(np.append(offset, offset[-1]), pa.int32()), pa.array(values, kind))


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        schema = pa.schema([("groups_sha256", pa.string()), *((c, pa.int64()) for c in _DOC[:-1])])
        block = TaskContext.get().partitionId() << 32
        parts, held = [], 0
        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                out, row, pair, times = aligner.slice(part.column("text"))
                parts.append((part.column("id"), out, row, pair, times))
                held += len(pair)
                if held >= BLOCK_PAIRS:
                    yield _block(block, parts, schema)
                    block, parts, held = block + 1, [], 0
        if parts:
            yield _block(block, parts, schema)

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of every document, written once: rows of documents (``pairs`` is null) and of blocks."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>, pairs array<long>, holders array<long>"
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return cut(texts.mapInArrow(_align(path_a, path_b), out), "zstd")


def _held(rows: DataFrame) -> DataFrame:
    return rows.filter("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("held"))


def pair_counts(rows: DataFrame, path_b: str) -> DataFrame:
    """(pair, a, b, n_docs, best): linked ids, the documents that hold them, and whether none of ``a`` has more."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = cut(_held(rows).groupBy("pair").agg(F.sum("held").alias("n_docs")))
    counts = counts.select("pair", F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b"), "n_docs")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their pairs."""
    right = right.sort_by("pair")
    counts, best = right["n_docs"].to_numpy(), right["best"].to_numpy(zero_copy_only=False).astype(np.int64)
    codes = left["codes"].combine_chunks()
    offset = codes.offsets.to_numpy() - codes.offsets[0].as_py()
    total = np.cumsum(pc.list_flatten(codes).to_numpy(), dtype=np.int64)
    times = pc.list_flatten(left["times"].combine_chunks()).to_numpy()
    before = np.repeat(np.concatenate([[0], total])[offset[:-1]], np.diff(offset))
    code = total - before
    sums = {"n_best": best[code] * times, "count_sum": counts[code] * times}
    sums = {k: np.diff(np.concatenate([[0], np.cumsum(v)])[offset]) for k, v in sums.items()}
    return pa.table({"id": left["id"], **{c: left[c] for c in _DOC}, **sums})


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A is a byte-level BPE file that encodes a blank and the text, B a sentencepiece model that adds the blank itself.
    Bytes where tokens of both end cut them into groups; all A-B token pairs of a group are links. The count of an
    id pair is the number of rows that hold it linked; ``n_best`` counts a row's links whose count is the highest of
    their A id, ties included, ``count_sum`` adds the counts of all links. Null and empty texts, and those that either
    tokenizer does not spell byte for byte, have no tokens: zeros and an empty text. Repeated rows and rows of one
    id are rows of their own; null ids stay. An empty table gives no rows; other columns are not looked at.
    """
    rows = aligned(docs, path_a, path_b, id_col, text_col)
    looked = _held(rows).select(F.col("block").alias("home"), "pair").join(pair_counts(rows, path_b).select("pair", "n_docs", "best"), "pair")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    texts = rows.filter("pairs is null").drop("pairs", "holders")
    scored = texts.groupBy("block").cogroup(looked.groupBy("home")).applyInArrow(_scored, out)
    return scored.withColumnRenamed("id", id_col)
