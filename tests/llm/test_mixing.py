"""Targets, apportionment and the mix itself."""

import re
from collections import Counter

import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st

from balanza.llm import mixing as X
from balanza.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [X.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = X.targets(sizes, weights)
    assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes))
    open_ = [t / w for t, w, s in zip(got, weights, sizes) if t < 3 * s - 1e-6]
    assert not open_ or max(open_) - min(open_) < 1e-6 * max(open_)


def by_heap(votes, seats, most):
    given_ = [0] * len(votes)
    for _ in range(seats):
        best = max(((votes[i] / (2 * given_[i] + 1), -i) for i in range(len(votes)) if given_[i] < most[i] and votes[i] > 0), default=None)
        if best is None:
            break
        given_[-best[1]] += 1
    return given_


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40)), min_size=1, max_size=9), st.integers(0, 120))
def test_apportionment_equals_seat_by_seat(parties, seats):
    votes, most = [float(v) + 0.01 * i * (v > 0) for i, (v, _) in enumerate(parties)], [m for _, m in parties]
    assert X.apportion(votes, seats, most) == by_heap(votes, seats, most)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got, block=X.BLOCK_WORDS):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = dict(zip(names, X.targets([sizes[s] for s in names], [X.WEIGHTS[i % 3] for i in range(len(names))])))
    source_of = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= block for s in names), (taken, want)


def test_query_and_partitioning(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    first = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in first} == {i: words(t) for i, t, _ in rows}
    check(rows, first)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    again = X.mix(docs).select(*first[0].__fields__).collect()
    assert sorted(first) == sorted(again)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_WORDS", 100)
    rows = [(i, "w " * (i % 50), ("hot", "b", None, "")[min(3, i % 9 // 2)] if i % 3 else "hot") for i in range(400)]
    rows += [(1000, None, "hot"), (1001, "", "only empty"), (1002, "x\vy\x1fz", "b")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, taken string")
    check(rows, X.mix(frame).collect())
    doubled = X.mix(frame.union(frame))
    assert doubled.count() == 2 * len(rows)
    assert X.mix(frame.limit(0)).count() == 0
    nothing = X.mix(frame.filter("text is null or text = ''")).collect()
    assert all(r.taken == 0 for r in nothing)


def test_documents_of_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r.doc_id: r.taken for r in X.mix(docs).collect()}
    made = X.mixed_documents(docs)
    assert made.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sums = Counter()
    for r in made.collect():
        sums[r.doc_id] += words(r.text)
        if r.text != texts[r.doc_id]:
            assert texts[r.doc_id].split()[: words(r.text)] == r.text.split()
    assert sums == Counter({k: v for k, v in plan.items() if v})


def test_names_that_clash(spark):
    names = ["mix_id", "mix_h", "mix_words", "mix_size", "mix_taken", "doc", "h", "taken"]
    docs = spark.createDataFrame([(i, "w " * 20, "s", *[k] * len(names)) for k, i in enumerate(range(30))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    made = X.mixed_documents(docs)
    assert made.columns == docs.columns and made.filter("mix_id <> mix_words or mix_id <> doc").count() == 0 and made.count() >= 30
