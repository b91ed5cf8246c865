"""Token files: exact against the library, round trips of the coder, and odd rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st

from balanza.llm import rans, words as W
from balanza.llm.token_files import PieceEncoder, TokenFile, pack, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


CODE = PieceEncoder(PATH)


def rows_of(texts, code=CODE):
    ids, at = code.encode(*W.strings(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_pieces_equal_the_library_on_whole_texts(library, sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    assert rows_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


HARD = ["", " ", "it's", "x.'s!'s", "we'll'll", "a≠b", "é .́", "ΑΣ.b ΑΣ b", "<|endoftext|>a<|ENDOFTEXT|>", "a|<b>", "1.5e-3", "日本 語.x", "a b c", "\x85\x1c.", "ÅÉ.é", "don't.don't", "<|startoftext|>", "﻿x", "İ.i"]


def test_hard_texts_equal_the_library(library):
    assert rows_of(HARD) == [library.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBcs'lve.,!<|>é́Σσ \n\t1≠ñ#", max_size=30), max_size=4))
def test_any_text_equals_the_library(texts):
    from tokenizers import Tokenizer

    lib = test_any_text_equals_the_library.__dict__.setdefault("lib", Tokenizer.from_file(PATH))
    assert rows_of(texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=700), st.integers(1, 9), st.integers(2, 300))
def test_file_round_trip(ids, lanes, block):
    ids = np.array(ids, dtype=np.uint32)
    index = pa.RecordBatch.from_pydict({"id": pa.array([7], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "crc32": pa.array([0], pa.int64())})
    file = TokenFile(pack(ids, index, block, lanes))
    assert np.array_equal(file.blocks(0, len(file.marks)), ids)
    a, b = len(ids) // 3, len(ids) // 2
    assert np.array_equal(file.span(a, b), ids[a:b])


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 300
    index = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "n_tokens": pa.array([5000], pa.int64()), "crc32": pa.array([0], pa.int64())})
    raw = bytearray(pack(ids, index))
    raw[-40] ^= 255
    with pytest.raises(ValueError):
        TokenFile(bytes(raw)).blocks(0, 1)


def test_skewed_and_single_symbols():
    for counts in ([1], [10**9, 1, 1], [1] * 5000):
        freq = rans.quantize(np.array(counts), rans.table_bits(len(counts)))
        assert freq.min() >= 1 and freq.sum() == 1 << rans.table_bits(len(counts))


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_a_table(spark, library):
    rows = [(5, "Some words, here.", 9), (2, None, 1), (9, "", 2), (None, "null id", 3), (7, "x " * 3000, 4), (1, "it's ok", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = read_token_files(write_token_files(docs, PATH, file_tokens=20), with_ids=True)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=lambda r: r[1]) == expected(library, [r[:2] for r in rows])
    assert all(len(r.ids) == r.n_tokens for r in got.collect())


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in read_token_files(write_token_files(docs, PATH)).collect())
    assert [r[0] for r in got] == [1, 1, 1] and sorted(r[2] for r in got) == [2, 3, 3]
    assert read_token_files(write_token_files(docs.limit(0), PATH)).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    from balanza.llm.token_files import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, code = Tokenizer.from_file(path), encoder(path)
    assert not code.by_pieces and encoder(PATH).by_pieces
    texts = ["Hello  world", "", "a\n\n b's", "日本 語.x", *HARD]
    ids, at = code.encode(*W.strings(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
