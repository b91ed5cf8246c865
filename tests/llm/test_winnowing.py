"""Winnowed matches against brute force, with short items, borders, repeats and odd rows."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from balanza.llm import winnowing as N


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        have, hit, found = words(text), set(), set()
        for item, needle in items:
            w = words(needle)
            m = min(len(w), window)
            if not m:
                continue
            grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
            for i in range(len(have) - m + 1):
                if tuple(have[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(have), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(have)))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5), st.integers(1, 4), st.integers(1, 5))
def test_every_long_shared_span_has_a_common_fingerprint(rows, k, w):
    flat = np.array([x for r in rows for x in r], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at, h = N.fingerprints(flat, first, k, w)
    prints = {(int(p), int(x)) for p, x in zip(at, h)}
    size = k + w - 1
    for a in range(len(rows)):
        for b in range(len(rows)):
            for i in range(len(rows[a]) - size + 1):
                for j in range(len(rows[b]) - size + 1):
                    if rows[a][i : i + size] == rows[b][j : j + size]:
                        left = {(p - first[a] - i, x) for p, x in prints if first[a] + i <= p <= first[a] + i + w - 1}
                        right = {(p - first[b] - j, x) for p, x in prints if first[b] + j <= p <= first[b] + j + w - 1}
                        assert left & right


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "d1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([13, 14, 30, 12, 5, 3, 1, 20])]
    items += [(None, "null item of five words"), (20, None), (21, "..."), (3, "z " * 15), (30, "z " * 13)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 12, 13, 40, 200])))
        if i % 3 == 0:
            needle = rng.choice(items)[1] or ""
            text = f"{text} {needle.upper() if i % 2 else needle.replace(' ', ', ')} {text[:40]}"
        docs.append((i, text))
    docs += [(60, None), (61, ""), (62, "!!"), (0, docs[0][1]), (None, items[2][1]), (63, "z " * 40), (64, "q " * 5000 + (items[0][1]) + " q" * 200)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item string").repartition(4)
    needles = spark.createDataFrame(items, "item_id long, text string")
    for window, k in ((13, 5), (6, 3), (4, 4)):
        got = N.decontaminate(frame, needles, window=window, k=k)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, window)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert [r.n_hit for r in N.decontaminate(docs, items.limit(0)).collect()] == [0]
    assert N.decontaminate(docs.limit(0), items).count() == 0
