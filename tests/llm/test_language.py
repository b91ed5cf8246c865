"""Language identification: Viterbi against brute force, held-out accuracy, mixed texts and odd rows."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from balanza.llm import language as L
from balanza.llm.queries import QUERIES, held_out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9), st.integers(-9, 9)), max_size=6), min_size=1, max_size=5), st.integers(0, 8))
def test_viterbi_equals_the_best_path(rows, penalty):
    flat = np.array([x for r in rows for x in r], dtype=np.float32).reshape(-1, 3)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = L.viterbi(flat, first, float(penalty))

    def value(row, path):
        return sum(row[i][p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    for i, row in enumerate(rows):
        if row:
            best = max(value(row, path) for path in itertools.product(range(3), repeat=len(row)))
            assert value(row, got[first[i] : first[i + 1]].tolist()) == best


def test_scripts():
    text = "aéΩжאع語かハ한ก9-©"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = [L.SCRIPTS[x] for x in L.script_of(raw)]
    at = np.cumsum([0] + [len(c.encode()) for c in text])[:-1]
    assert [found[i] for i in at] == ["latin", "latin", "greek", "cyrillic", "hebrew", "arabic", "han", "kana", "kana", "hangul", "thai", "none", "none", "none"]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return L.fit_languages(docs.filter(~held_out("doc_id", 4, 2)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language_id"](spark, sf).join(docs, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98 and got.count() > 200


def test_mixed_texts_are_cut_into_spans(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picks = {r.lang: r.text for r in docs.filter("n_chars between 600 and 1500").collect()}
    de, fr = " ".join(picks["de"].split()[:60]), " ".join(picks["fr"].split()[:30])
    frame = spark.createDataFrame([(1, f"{de} {fr}", "x"), (2, fr, "y")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in L.detect_languages(frame, model, spans=True).collect()}
    assert got[1].lang_pred == "de" and 0.5 < got[1].score < 0.9
    names = [s.lang for s in got[1].spans]
    assert names == ["de", "fr"] and abs(got[1].spans[0].end - 60) <= 6
    assert got[2].lang_pred == "fr" and len(got[2].spans) == 1 and got[2].score == 1


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 -- !!"), (4, "Привет мир"), (None, "the and of that this"), (5, "the and of " * 9000), (5, "the and of " * 9000), (6, "ª"), (7, "١٢")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(map(str, (tuple(r)[:2] for r in L.detect_languages(frame, model).collect())))
    some = {i: lang for i, lang, _ in L.detect_languages(frame, model).collect()}
    assert some[1] == some[2] == some[3] == some[7] == "und" and some[4] in model.langs and some[None] == "en" and some[5] == "en" and some[6] in model.langs
    assert len(got) == len(rows)
    assert L.detect_languages(frame.limit(0), model).count() == 0
    empty = L.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in L.detect_languages(frame, empty).collect()} == {"und"}


def test_candidates_of_a_script(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γεια σου κόσμε", "el")] * 5)]
    model = L.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    frame = spark.createDataFrame([(1, "мир"), (2, "κόσμε σου world"), (3, "how world")], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(L.detect_languages(frame, model).collect())] == ["ru", "el", "en"]


def test_one_language(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'de' and text is not null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.score} == {"de"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.score == 1 for r in got if any(map(str.isalpha, texts[r.doc_id])))
    model = L.fit_languages(docs)
    frame = spark.createDataFrame([(1, "мир"), (2, "nicht мир")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.detect_languages(frame, model).collect()} == {1: ("de", 0.0), 2: ("de", 5 / 11)}
