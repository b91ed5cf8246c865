"""The pipeline: each stage against a brute-force version on the smallest tables."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from balanza.llm import mixing as X
from tests.llm.test_ngram_join import brute as join
from tests.llm.test_winnowing import brute as windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    extra = spark.createDataFrame([(90001, None, None, None, 0), (90002, "12 -- 34", "en", "src0", 8), (90003, "", "fr", None, 0)], docs.schema)
    docs = docs.union(extra).union(docs.filter("doc_id = 3")).cache()
    stages = dict(P.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "mixing", "tokens"]

    kept = stages["language"](spark, docs, sf_dir).cache()
    assert kept.columns == COLUMNS
    gone = {r.doc_id for r in docs.join(kept, "doc_id", "left_anti").collect()}
    assert gone >= {90001, 90002, 90003} and len(gone) <= 5

    single = stages["near_duplicates"](spark, kept, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({i for i, _, low in join(rows, 5, 80, 100) if i == low})
    assert single.columns == COLUMNS

    clean = stages["benchmark"](spark, single, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in windows(rows, items, 13) if not r[5])

    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    assert mixed.columns == COLUMNS
    plan = {r.doc_id: r.taken for r in X.mix(clean).collect() if r.taken}
    sums = {}
    for r in mixed.collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert sums == plan

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(map(tuple, stages["tokens"](spark, mixed, sf_dir).collect()), key=lambda r: r[1])
    want = []
    for r in mixed.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(want)
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
    assert got.filter(F.col("n_tokens") < 1).count() == 0


def test_language_stage_with_one_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).filter("lang = 'fr' and text rlike '[a-zA-Z]'")
    assert dict(P.STAGES)["language"](spark, docs, sf_dir).count() == docs.count() > 10


def test_near_duplicates_keeps_one_row_of_a_group(spark, sf_dir):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = f"{b} more"
    rows = [(7, a), (7, near), (3, b), (None, a), (None, "c d e f g h"), (None, "c d e f g h"), (8, "C d e f g h"), (None, "i j k l m n"), (None, "i j k l m n"), (5, "x y"), (6, "x y"), (6, "x y"), (None, "x y"), (9, None), (9, None), (10, " "), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(P.STAGES)["near_duplicates"](spark, docs.repartition(5), sf_dir)
    want = [(3, b), (5, "x y"), (7, a), (8, "C d e f g h"), (9, None), (10, " "), (None, " "), (None, "i j k l m n")]
    assert got.columns == COLUMNS and sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, want))


def test_columns_of_the_stages_names_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).limit(40)
    for name in ("text_hash", "id", "body", "doc", "keep_id", "mix_words"):
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    for name in ("near_duplicates", "benchmark", "mixing"):
        got = dict(P.STAGES)[name](spark, docs, sf_dir)
        assert got.columns == docs.columns and got.count() > 0 and got.filter("text_hash <> 2 * doc_id or body <> text_hash or id <> doc").count() == 0
