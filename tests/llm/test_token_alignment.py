"""Alignment of two tokenizers against a plain token-by-token version on whole texts."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from balanza.llm import token_alignment as T
from balanza.llm.queries import QUERIES
from balanza.llm.token_alignment import align_tokenizers, aligned, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet = T.byte_level_alphabet()
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append(None)
            continue
        groups, one, two, ends, pos = [], [], [], [set(), set()], 0
        for k, parts in enumerate((bytes_a, bytes_b)):
            at = 0
            for p in parts:
                at += len(p)
                ends[k].add(at)
        both = ends[0] & ends[1]
        i = j = x = y = 0
        for end in sorted(both):
            one, two = [], []
            while x < end:
                x += len(bytes_a[i])
                one.append(a[i])
                i += 1
            while y < end:
                y += len(bytes_b[j])
                two.append(b[j])
                j += 1
            groups.append((one, two))
        rows.append((a, b, groups))
    count = collections.Counter()
    for row in rows:
        if row:
            count.update({(x, y) for one, two in row[2] for x in one for y in two})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for one, two in row[2] for x in one for y in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in row[2])
        out.append((len(row[0]), len(row[1]), len(row[2]), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [
    "Hello world, this is a test.", "", None, " ", "  two  blanks ", "tab\tand\nlines\r\n  end \n", "a <|endoftext|> b <s> </s> <unk> <0x41>", "no▁break", "漢字 かな 😀 　wide  nbsp", "a" * 700,
    "word  wide then blank", "x  y", "don't  stop'll we 'd", "\x00nul \x7fdel", "   leading", "trailing   ", "Ünïcödé straße", "́ combining é", "12345 67 890", "a b c d e f", "Hello world, this is a test.",
    "=" * 300 + " " * 300 + "-" * 77, "the the the THE the", "﻿bom", "a\u0085b   c",
]


def test_odd_texts_against_brute_force(spark):
    df = spark.createDataFrame([(i % 7 or None, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a int, block string").repartition(3)
    got = collections.Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in align_tokenizers(df, A, B).collect())
    assert got == collections.Counter((i % 7 or None, *row) for i, row in enumerate(brute(ODD)))


def test_small_blocks_and_large_groups(spark, monkeypatch):
    """Blocks of a few documents, links expanded in small steps, every group reduced to distinct ids."""
    monkeypatch.setattr(T, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(T, "LINKS", 7)
    monkeypatch.setattr(T, "LARGE_GROUP", 1)
    monkeypatch.setattr(T, "SLICE", 60)
    rng = random.Random(4)
    words = ["alpha", "beta", "naïve", "x1y2", "--", "ÅÄ", "supercalifragilistic", "\n", "  ", "zzzz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ODD
    want = brute(texts)
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    aligner = T.Aligner(A, B)
    out, row, pair, times = aligner.slice(batch.column("text"))
    assert [tuple(int(out[c][i]) for c in T._DOC[:4]) + (out["groups_sha256"][i],) for i in range(len(texts))] == [w[:4] + w[6:] for w in want]
    assert collections.Counter(row.tolist()) and times.sum() == sum(w[3] for w in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert align_tokenizers(df, A, B).collect() == []


def test_pair_counts_of_documents(spark):
    rows = aligned(spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the")], "doc_id long, text string").repartition(2), A, B)
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    the = tok.encode(" the").ids[0], sp.encode("the")[0]
    found = {(r.a, r.b): (r.n_docs, r.best) for r in pair_counts(rows, B).collect()}
    assert found[the] == (3, True)


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_against_brute_force(spark, sf):
    docs = pq.read_table(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute(docs["text"].to_pylist())
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, f"/root/testdata/sf{sf}").collect()}
    assert got == dict(zip(docs["doc_id"].to_pylist(), want, strict=True))
