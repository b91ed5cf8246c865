"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (statistics of its characters and words, then one learned
layer); gated attention, learned from document labels alone, weighs the passages; the score is a logistic function
of the weighted representation. Fitting runs on the driver over a bounded sample; scoring runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from balanza.llm import words as W

#: Words of a passage, about: a text is cut into equal passages of at most so many.
PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on, about, chosen by the hash of their ids, with all of their passages.
SAMPLE_DOCS = 8000
#: Texts of one id that the fit looks at.
SAMPLE_ROWS = 4
#: Passages that a step of fitting holds at a time, about.
STEP_PASSAGES = 1 << 18
ENCODED, HIDDEN, STEPS, RATE, SEED = 16, 16, 400, 0.02, 11

_CLASS = np.full(256, 5, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sentence marks, 4 other ASCII marks, 5 non-ASCII, 6 blanks and controls
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[33:48], _CLASS[58:65], _CLASS[91:97], _CLASS[123:127] = 4, 4, 4, 4
_CLASS[list(b".,;:'\"!?()-")] = 3
_CLASS[:33], _CLASS[127] = 6, 6
CLASSES = 6
FEATURES = CLASSES + 12


def passage_features(data: np.ndarray, at: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature) and the first passage of each row, with the end; a row without words has one passage of zeros."""
    starts, ends, first = W.word_bounds(data, at, W.SPACED)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // size))
    offset = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((offset[-1], FEATURES), dtype=np.float32)
    if not len(starts):
        return out, offset
    row = np.repeat(np.arange(len(count)), bags)
    inner = np.arange(offset[-1]) - offset[row]
    head = first[row] + inner * count[row] // bags[row]
    real = np.flatnonzero(count[row] > 0)
    head = head[real]
    tail = np.concatenate([head[1:], [len(starts)]])
    n = (tail - head).astype(np.float64)
    of = np.repeat(np.arange(len(head)), tail - head)
    hashes = W.span_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    lo, hi = starts[head], ends[tail - 1]
    kind = _CLASS[data]
    total = (hi - lo).astype(np.float64)
    for c in range(CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)])
        out[real, c] = (sums[hi] - sums[lo]) / total
    put = CLASSES

    def mean(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), head) / n

    average = mean(length)
    last, opening = data[ends - 1], data[starts]
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    keys = W.mix(hashes ^ W.mix(of.astype(np.uint64)))
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    distinct = np.bincount(of[order][fresh], minlength=len(head))
    upper = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum(kind >= 3, dtype=np.int64)])
    feeds = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    for values in (
        np.minimum(average, 40) / 10, np.sqrt(np.maximum(0, np.minimum(mean(length * length) - average**2, 400))) / 10, distinct / n, mean(again),
        mean(_CLASS[last] == 4), mean(_CLASS[last] == 3), mean(_CLASS[opening] == 1), mean(upper[ends] - upper[starts] == ends - starts),
        mean(marks[ends] - marks[starts] == ends - starts), (feeds[hi] - feeds[lo]) / n, np.minimum(n, size) / size, np.ones(len(n)),
    ):
        out[real, put] = values
        put += 1
    return out, offset


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage); every bag has a passage."""
        return _forward((x - self.mean) / self.scale, offset, self.weights)[:2]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(x: np.ndarray, offset: np.ndarray, w: dict[str, np.ndarray]):
    bag, first = np.repeat(np.arange(len(offset) - 1), np.diff(offset)), offset[:-1]
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * g) @ w["w"]
    a = np.exp(a - np.maximum.reduceat(a, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(h * a[:, None], first, axis=0)
    return _sigmoid(z @ w["c"] + w["b"]), a, h, t, g, z, bag, first


def fit(x: np.ndarray, offset: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """A model of bags of passages; Adam on the mean log loss with a little weight decay."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    w = {
        "E": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], ENCODED)), "e": np.zeros(ENCODED), "V": rng.normal(0, ENCODED**-0.5, (ENCODED, HIDDEN)),
        "U": rng.normal(0, ENCODED**-0.5, (ENCODED, HIDDEN)), "w": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": rng.normal(0, ENCODED**-0.5, ENCODED), "b": np.zeros(1),
    }
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    cuts = np.unique(np.searchsorted(offset[1:], np.arange(STEP_PASSAGES, offset[-1], STEP_PASSAGES), side="left") + 1)
    edges = [0, *(c for c in cuts.tolist() if c < len(labels)), len(labels)]
    chunks = list(zip(edges[:-1], edges[1:], strict=True))
    for step in range(1, steps + 1):
        grads: dict[str, np.ndarray] = {}
        for i, j in chunks:
            lo, hi = offset[i], offset[j]
            p, a, h, t, g, z, bag, first = _forward(x[lo:hi], offset[i : j + 1] - lo, w)
            d = (p - labels[i:j]) / len(labels)
            dz = d[:, None] * w["c"]
            # the weighted sum: to the passages, and to the attention through its softmax
            da = (dz[bag] * h).sum(axis=1)
            ds = a * (da - np.add.reduceat(a * da, first)[bag])
            dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
            part = {"E": x[lo:hi].T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (ds[:, None] * t * g).sum(axis=0), "c": z.T @ d, "b": d.sum(keepdims=True)}
            grads = {k: grads[k] + v for k, v in part.items()} if grads else part
        for k, v in grads.items():
            v = v + 1e-4 * w[k]
            one[k] = 0.9 * one[k] + 0.1 * v
            two[k] = 0.999 * two[k] + 0.001 * v * v
            w[k] = w[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in W.slices(batch, "text"):
            x, offset = passage_features(*W.strings(rows.column("text")))
            bags = [x[a:b].astype("<f4").tobytes() for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array(bags, pa.binary())], names=["id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from the labelled documents; None if there is no label. Rows without label are left out.

    Labels of one id that differ count with their mean. Of rows with one id at most ``SAMPLE_ROWS`` different texts,
    those of the smallest hashes, are learned from, so that about ``sample_docs`` times as many rows come to the driver
    at most. Both only bound what is fitted; scoring sees every row.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    total = known.count()
    if not total:
        return None
    chance = (F.pmod(F.xxhash64(F.lit("quality sample"), "id"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    chosen = known.filter(chance < min(1.0, sample_docs / total)).groupBy("id").agg(F.avg("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most about sample_docs pairs of numbers are broadcast
    drawn = texts.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("id").orderBy("h")
    drawn = drawn.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= SAMPLE_ROWS).dropDuplicates(["id", "h"])
    rows = drawn.select("id", "label", "text").mapInArrow(_bags, f"id {docs.schema[id_col].dataType.simpleString()}, label double, x binary")
    bags = sorted(rows.collect(), key=lambda r: (r.id, r.x))
    if not bags:
        return None
    x = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in bags]
    return fit(np.concatenate(x), np.concatenate([[0], np.cumsum([len(v) for v in x])]), np.array([r.label for r in bags]))


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in W.slices(batch, "text"):
                if model is None:
                    score, top = np.full(rows.num_rows, 0.5), np.zeros(rows.num_rows, dtype=np.int64)
                else:
                    x, offset = passage_features(*W.strings(rows.column("text")))
                    score, weight = model.forward(x, offset)
                    peak = np.maximum.reduceat(weight, offset[:-1])
                    hit = np.flatnonzero(weight == np.repeat(peak, np.diff(offset)))
                    top = hit[np.searchsorted(hit, offset[:-1])] - offset[:-1]
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in keep] + [pa.array(score, pa.float64()), pa.array(top, pa.int64())], names=[*keep, "score", "passage"])

    return run


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with score (0 to 1, likelier label 1 when higher) and passage (number of the passage with
    most weight) for every row. Null, empty and blank texts are one passage without words and are scored like
    any other; without a model every score is 0.5."""
    names = {f"k{i}": c for i, c in enumerate(keep)}
    source = docs.select(*[F.col(c).alias(k) for k, c in names.items()], F.col(text_col).alias("text"))
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in names.items())
    found = source.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), list(names)), f"{schema}, score double, passage long")
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], "score", "passage")
