"""Quality: gradients of the model by differences, held-out accuracy, attention and odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from balanza.llm import quality as Q, words as W
from balanza.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op5_quality"](spark, sf).cache()
    known = got.join(labels, "doc_id").filter("held_out and quality is not null")
    assert known.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.95
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_bags_learn_from_their_labels_alone():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 300)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(0, 1, (offset[-1], 5)).astype(np.float32)
    labels = np.zeros(300)
    for i in range(0, 300, 2):  # one telling passage makes a bag positive
        x[offset[i] + rng.integers(sizes[i]), 0] += 6
        labels[i] = 1
    model = Q.fit(x, offset, labels, steps=300)
    score, weight = model.forward(x, offset)
    assert ((score >= 0.5) == (labels == 1)).mean() > 0.95
    tops = [offset[i] + weight[offset[i] : offset[i + 1]].argmax() for i in range(0, 300, 2)]
    assert (x[tops, 0] > 3).mean() > 0.9
    assert np.allclose(np.add.reduceat(weight, offset[:-1]), 1)


def test_features_do_not_depend_on_neighbours():
    texts = ["", "one", "A b. c!! " * 100, None, "x | y | z\n" * 30, "é"]
    together, offset = Q.passage_features(*W.strings(pa.array(texts)))
    for i, text in enumerate(texts):
        alone, own = Q.passage_features(*W.strings(pa.array([text], pa.string())))
        assert np.allclose(together[offset[i] : offset[i + 1]], alone) and own[-1] == len(alone)
    assert not together[0].any() and len(together) == offset[-1]


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "a " * 30000), (3, "a " * 30000), (4, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("passage", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1), (2, 0), (2, 0), (1, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 4)}) == 1
    assert Q.fit_quality(docs, labels.limit(0)) is None
    assert {r.score for r in Q.score_quality(docs, None).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), model).count() == 0


def test_fitting_takes_all_passages_of_a_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, offset, labels: seen.append((x, offset)))
    text = "good words here. " * 5000 + "x | y | z\n" * 40 + "good words here. " * 2000
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    Q.fit_quality(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    want, offset = Q.passage_features(*W.strings(pa.array([text, "short one"])))
    assert offset[1] > 300 and seen[0][1].tolist() == offset.tolist() and np.array_equal(seen[0][0], want)


def test_steps_in_pieces_give_the_same_model(monkeypatch):
    rng = np.random.default_rng(3)
    offset = np.concatenate([[0], np.cumsum([*rng.integers(1, 9, 60), 200, 1, 3])])
    x, labels = rng.normal(0, 1, (offset[-1], 5)).astype(np.float32), rng.integers(0, 2, 63).astype(float)
    whole = Q.fit(x, offset, labels, steps=20)
    monkeypatch.setattr(Q, "STEP_PASSAGES", 40)
    pieces = Q.fit(x, offset, labels, steps=20)
    assert all(np.allclose(whole.weights[k], pieces.weights[k], atol=1e-6) for k in whole.weights)


def test_hot_ids_and_labels_that_differ(spark, monkeypatch):
    """Of one id a few texts are learned from, copies once; differing labels count with their mean, in any order."""
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, offset, labels: seen.append((len(offset) - 1, labels.tolist())))
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(500)] + [(2, "two")] * 9, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    for frame in (labels, labels.orderBy(F.desc("quality"))):
        Q.fit_quality(docs, frame)
    assert seen[0] == seen[1] == (Q.SAMPLE_ROWS + 1, [0.5] * Q.SAMPLE_ROWS + [1.0])
