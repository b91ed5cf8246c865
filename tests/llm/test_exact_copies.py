"""Counting quotient filters by round trip, and copies against a plain grouping of normalised texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from balanza.llm import exact_copies as E
from balanza.llm.exact_copies import exact_copies, merge_counts, pack_filter, unpack_filter, without_copies


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000])
@pytest.mark.parametrize("bits", [12, 27, 48])
def test_filter_gives_back_what_it_holds(n, bits):
    rng = np.random.default_rng(n + bits)
    prints = np.unique(rng.integers(0, 1 << bits, size=n, dtype=np.uint64))
    counts = rng.integers(1, 4, size=len(prints)).astype(np.uint64)
    counts[: len(counts) // 9] = 1 << 40
    back, again = unpack_filter(pack_filter(prints, counts, bits))
    assert back.tolist() == prints.tolist() and again.tolist() == counts.tolist()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    parts, total = [], {}
    for size in (0, 3, 500, 80):
        drawn = rng.integers(0, 900, size=size, dtype=np.uint64) << np.uint64(30)
        prints, counts = np.unique(drawn, return_counts=True)
        parts.append(unpack_filter(pack_filter(prints, counts.astype(np.uint64), 48)))
        for p in drawn.tolist():
            total[p] = total.get(p, 0) + 1
    prints, counts = merge_counts(parts)
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == total and prints.tolist() == sorted(total)


def brute(rows):
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, text, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, text, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, extra=""):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, keep_id int").repartition(5)
    got = exact_copies(df).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.id == r.keep_id for r in kept)
    left = without_copies(df)
    assert left.columns == df.columns and left.count() == len(kept)


def test_odd_rows(spark):
    long = "word  another\t" * 40_000
    rows = [(3, "a b"), (1, "a\t\n b"), (2, "a b"), (4, None), (5, ""), (6, " "), (7, "\n\t "), (None, "a b"), (None, None), (9, " a b"), (9, "a b "),
            (10, long), (11, long.replace("\t", " ")), (1, "a b"), (1, "a\t\n b"), (12, "ü ß 漢字"), (13, "ü  ß\r漢字"), (14, "A b"), (None, "only null"), (None, "only  null")]
    check(spark, rows)


def test_many_copies_of_one_text_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(E, "SEGMENT_BITS", 5)
    monkeypatch.setattr(E, "HELD", 16)
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot text here"] * 6 + [f"text {rng.randrange(300)}", f"text\t{rng.randrange(300)}"])) for i in range(900)]
    check(spark, rows)


def test_a_false_route_only_adds_work(spark, monkeypatch):
    monkeypatch.setattr(E, "routing_table", lambda filters, seg_bits: np.full(1 << (E.ROUTE_BITS - 3), 255, np.uint8))
    check(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert exact_copies(df).collect() == [] and without_copies(df).columns == df.columns


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x  y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    assert {r.id: (r.keep_id, r.kept) for r in exact_copies(df).collect()} == {"b": ("a", False), "a": ("a", True), "c": ("c", True)}
