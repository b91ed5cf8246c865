"""Angular bounds, and mined negatives against a plain comparison of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from balanza.llm import hard_negatives as H
from balanza.llm.hard_negatives import Best, angles, bounds, directions, hard_negatives, scored


def brute(rows, positives=5, negatives=10, low=30, high=90, den=100, every=10):
    ok = [
        (i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in ok:
        if i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in ok]
        mine = sorted([s for s in score if s[2] == label and s[1] != i], key=lambda s: (-s[0], s[1]))[:positives]
        for p, pid, _ in mine:
            fits = sorted([s for s in score if s[2] != label and low * p <= den * s[0] <= high * p], key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def check(spark, rows, parts=4, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, anchor string").repartition(parts)
    got = hard_negatives(df, F.col("vec_id") % how.pop("every", 10) == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(1)
    base = rng.integers(-300, 300, size=(30, 6)).astype(float)
    v = np.concatenate([base, base * 3, -base, base + rng.integers(-1, 2, size=base.shape), np.zeros((1, 6)), base[:1] * 1e6])
    norms = np.sqrt((v * v).sum(axis=1))
    refs = directions(v)
    assert np.allclose((refs * refs).sum(axis=1), 1) and len(refs) == H.REFERENCES
    theta = angles(v, norms, refs)
    low, high = bounds(theta, norms, theta, norms)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    # they rule out something: parallel and opposite rows are far apart
    assert (high[:30, 60:90].diagonal() < 0).any()


def test_scores_of_thin_and_dense_masks():
    rng = np.random.default_rng(2)
    a, v = rng.integers(-99, 99, size=(20, 5)), rng.integers(-99, 99, size=(40, 5))
    for share in (0, 0.02, 0.9):
        mask = rng.random((20, 40)) < share
        assert (scored(a, v, mask) == np.where(mask, a @ v.T, H.NONE)).all()
    big = np.full((1, 2), 1 << 28)
    assert scored(big, big, np.ones((1, 1), bool))[0, 0] == 1 << 57
    with pytest.raises(OverflowError):
        scored(big * 16, big * 16, np.ones((1, 1), bool))


@pytest.mark.parametrize("span", [3, 1 << 60])
def test_best_lists_keep_ties_by_smaller_id(span):
    rng = random.Random(span)
    best, all_ = Best(3, 4), [[] for _ in range(3)]
    for start in range(0, 60, 20):
        ids = np.sort(np.array(rng.sample(range(1000), 20)))
        s = np.array([[rng.choice([H.NONE, rng.randrange(-span, span), 1]) for _ in ids] for _ in range(3)])
        best.add(np.arange(3), s, ids)
        for k in range(3):
            all_[k] += [(-x, i) for x, i in zip(s[k].tolist(), ids.tolist(), strict=True) if x > H.NONE]
    for k in range(3):
        assert [(-x, i) for x, i in zip(best.score[k].tolist(), best.id[k].tolist(), strict=True)] == sorted(all_[k])[:4]


def test_clusters_copies_ties_and_odd_rows(spark):
    rng = random.Random(7)
    centers = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(260):
        c = rng.choice(centers)
        v = c if rng.random() < 0.4 else [x + rng.uniform(-0.2, 0.2) for x in c]
        rows.append((i, rng.randrange(3), [float(np.float32(x)) for x in v]))
    rows += [(300, None, [1.0] * 8), (301, 1, None), (310, 1, [float("nan")] * 8), (320, 1, [1.0, None] * 4), (330, 1, [float("inf")] + [0.0] * 7),
             (340, 1, [0.0] * 8), (350, 2, []), (360, 2, [0.5, 0.25]), (None, 1, [0.1] * 8), (370, 7, [0.3] * 8), (-10, 0, [-0.5] * 8)]
    assert check(spark, rows) == brute(rows)


def test_chunks_of_anchors_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 7)
    monkeypatch.setattr(H, "PART", 40)
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), [float(rng.randrange(-3, 4)) / 4 for _ in range(3)]) for i in range(150)]
    want = brute(rows, positives=2, negatives=3, low=10, high=100, every=3)
    assert check(spark, rows, every=3, positives=2, negatives=3, low=10, high=100) == want


def test_repeated_rows_count_as_often_as_they_stand(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.0])]
    assert check(spark, rows) == brute(rows)


def test_without_anchors_or_rows(spark):
    assert check(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id long, label string, embedding array<double>")
    assert hard_negatives(df, F.col("vec_id") == 0).collect() == []


def test_text_labels(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "b", [0.5, 0.5])], "vec_id long, label string, embedding array<double>")
    assert [tuple(r) for r in hard_negatives(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
