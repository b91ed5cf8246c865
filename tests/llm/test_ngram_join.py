"""The n-gram join against brute force, on texts with many near copies, ties and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from balanza.llm import words as W
from balanza.llm.components import components
from balanza.llm.ngram_join import first_meeting, gram_classes, gram_entries, ngram_jaccard_join
from balanza.llm.queries import QUERIES


def gram_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n, num, den):
    sets = [gram_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        low = None if doc is None else doc if not sets[i] else min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
        out.append((doc, len(sets[i]), low))
    return sorted(out, key=str)


def mutated(seed, bases=4, copies=22):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    texts = ["Same text twice here", "same TEXT twice\there", "", None, " \n", "one", "One", "two words", "two  words", "three of them"]
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 120]))] + common
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary + ["new" + str(rng.random())])
            if rng.random() < 0.2:
                words = words[: -rng.randrange(1, 4)]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=10))
    rows += [(rows[0][0], rows[0][1]), (None, rows[5][1]), (None, None), (7, rows[6][1]), (7, "another text under an id that is there")]
    return rows


@pytest.mark.parametrize("seed,n,num", [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_equals_brute_force(spark, seed, n, num):
    rows = mutated(seed)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, gid string").repartition(3)
    got = ngram_jaccard_join(docs, n=n, num=num, den=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, n, num, 100)


def test_text_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "x y z w"), ("a", "X y z w"), ("c", "other words stand here")], "k string, body string")
    assert sorted(map(tuple, ngram_jaccard_join(docs, "k", "body").collect())) == [("a", 2, "a"), ("b", 2, "a"), ("c", 2, "c")]
    assert ngram_jaccard_join(docs.limit(0), "k", "body").count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(50, 50), (6, 5), (61, 60), (60, 61)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 30)}, 50: 50, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_equal_a_plain_split(sf_dir):
    texts = [*pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60], "", "a", " A b\vc ", "É é", "x" * 5000]
    import pyarrow as pa

    for flags, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, at = W.strings(pa.array(texts))
        starts, ends, first = W.word_bounds(data, at, flags)
        low = W.LOWER[data].tobytes()
        hashes = W.span_hashes(data, starts, ends)
        seen = {}
        for i, text in enumerate(texts):
            words = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text))
            own = range(first[i], first[i + 1])
            assert [low[starts[k] : ends[k]].decode() for k in own] == words
            for k, word in zip(own, words):
                assert seen.setdefault(word, hashes[k]) == hashes[k]
        assert len(set(seen.values())) == len(seen)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, QUERIES["op3_ngram_jaccard_join"](spark, sf_dir).collect()), key=str) == brute(rows, 3, 90, 100)


def test_pairs_meet_once(spark):
    """Groups that share a passage meet at its first n-gram, and at no later n-gram that others have too."""
    run, tail = list(range(100, 130)), [200, 201]
    prefixes = {g: [g, *run, *tail] for g in range(1, 13)} | {20: [20, *tail]}  # 12 groups share the passage, 13 its last grams
    groups = spark.createDataFrame([(g, 300, p) for g, p in prefixes.items()], "gid long, n long, prefix array<long>")
    met = spark.createDataFrame([(t, g) for g, p in prefixes.items() for t in p[1:]], "tok long, gid long")
    many = spark.createDataFrame([(g, int(g == 20)) for g in prefixes], "gid long, many int")
    entries = gram_entries(met, groups, many)
    assert sorted(map(tuple, entries.select("tok", "gid", "np", "k").collect())) == sorted(
        [(100, g, (1 << 32) + 300, 12) for g in range(1, 13)] + [(200, g, (31 << 32) + 300, 14) for g in range(1, 13)] + [(200, 20, (1 << 32) + 300, 14)]
    )
    x, y = entries.select("tok", F.col("gid").alias("x"), F.col("earlier").alias("ex")), entries.select("tok", F.col("gid").alias("y"), F.col("earlier").alias("ey"))
    pairs = [tuple(r) for r in x.join(y, "tok").filter("x < y").filter(first_meeting("ex", "ey")).select("x", "y").collect()]
    assert sorted(pairs) == [(a, b) for a in prefixes for b in prefixes if a < b]


def test_grams_of_a_few_dozen_texts_come_last(spark):
    """Among two million n-grams the count table still tells those of 24 texts from those of one."""
    own = [" ".join(f"{t}x{i}" for i in range(16_000)) for t in range(120)]
    shared = " ".join(f"s{i}" for i in range(40))
    texts = spark.createDataFrame([(f"{t} | {shared}" if i < 24 else t,) for i, t in enumerate(own)], "text string").repartition(4)
    classes = gram_classes(texts, 1, bits=17)
    grams = next(iter(W.gram_sets(*W.strings(pa.array([shared])), 1)))
    assert (classes[(grams >> np.uint64(64 - 17)).astype(np.int64)] > 0).mean() > 0.5
    assert (classes > 0).mean() < 0.02
