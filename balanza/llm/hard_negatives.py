"""Hard negatives by angular triangle filtering.

Components are whole numbers, so scores are exact inner products. Every row stores its norm and its angles to a few
reference directions. For an anchor and a row the triangle inequality on the sphere gives, with each reference,

    |phi - theta|  <=  angle(anchor, row)  <=  min(phi + theta, 2 pi - phi - theta)

and so an interval of the cosine, which times both norms bounds the score. The bounds are widened by more than
rounding can cost. Only pairs whose interval overlaps the wanted window are scored in whole numbers: for positives
what may still be among the first of the anchor, for negatives what may lie between the shares of a positive's
score and still be among the first of it.

Anchors go to the tasks in chunks of fixed size; a task keeps the first few rows of each anchor and positive,
and Spark ranks the tasks' lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from balanza.session import checkpoint_root, cut

#: Reference directions, and the anchors they are chosen from.
REFERENCES, CHOICE = 8, 4096
#: Anchors that are broadcast at once: with 64 components 4 MB.
CHUNK = 8192
#: Rows of a partition.
PART = 8192
TILE_ANCHORS, TILE_ROWS = 512, 2048
#: The bounds are widened by this share of both norms' product, and by one.
SLACK = 1e-7
NONE = -(1 << 62)


def directions(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from one another: the first row, then always the one with the largest angle to the nearest taken."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors[norms > 0] / norms[norms > 0, None]
    taken: list[int] = []
    near = np.full(len(unit), -2.0)
    while len(taken) < min(count, len(unit)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references; of zero vectors 0, as their bounds are 0 anyway."""
    safe = np.where(norms > 0, norms, 1.0)
    return np.where(norms[:, None] > 0, np.arccos(np.clip(vectors @ references.T / safe[:, None], -1, 1)), 0.0)


def bounds(phi: np.ndarray, norm_a: np.ndarray, theta: np.ndarray, norm_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with each row, from their angles and norms."""
    low, high = np.zeros((len(phi), len(theta))), np.full((len(phi), len(theta)), np.pi)
    for j in range(phi.shape[1]):
        np.maximum(low, np.abs(phi[:, j, None] - theta[None, :, j]), out=low)
        total = phi[:, j, None] + theta[None, :, j]
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    both = norm_a[:, None] * norm_v[None, :]
    slack = both * SLACK + 1
    return both * np.cos(high) - slack, both * np.cos(low) + slack


def scored(a: np.ndarray, v: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the masked pairs, NONE elsewhere."""
    out = np.full(mask.shape, NONE, dtype=np.int64)
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return out
    largest = [float(np.abs(x).max(initial=0)) for x in (a, v)]
    if largest[0] * largest[1] * a.shape[1] >= 1 << 61:
        raise OverflowError("scores do not fit in 64 bits")
    if largest[0] * largest[1] * a.shape[1] < 1 << 53:  # exact in doubles
        a, v = a.astype(np.float64), v.astype(np.float64)
    if 8 * int(mask.sum()) < len(rows) * len(cols):
        i, j = np.nonzero(mask)
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            out[i[part], j[part]] = np.einsum("ij,ij->i", a[i[part]], v[j[part]])
    else:
        some = (a[rows] @ v[cols].T).astype(np.int64)
        out[np.ix_(rows, cols)] = np.where(mask[np.ix_(rows, cols)], some, NONE)
    return out


class Best:
    """The first ``k`` (score, id) of each list, higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score, self.id = np.full((lists, k), NONE, np.int64), np.zeros((lists, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows ``ids`` (ascending) for some lists; NONE is no candidate."""
        busy = np.flatnonzero((scores > NONE).any(axis=1))
        if not len(busy):
            return
        lists, scores = lists[busy], scores[busy]
        n = scores.shape[1]
        if n > self.k:
            if int(np.abs(np.where(scores > NONE, scores, 0)).max()) < (1 << 61) // n:
                key = np.where(scores > NONE, scores * n - np.arange(n), NONE)  # equal scores: the earlier id is larger
                top = np.argpartition(key, n - self.k, axis=1)[:, n - self.k :]
            else:
                top = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, : self.k]
            scores, found = np.take_along_axis(scores, top, axis=1), ids[top]
        else:
            found = np.broadcast_to(ids, scores.shape)
        scores, found = np.concatenate([self.score[lists], scores], axis=1), np.concatenate([self.id[lists], found], axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.score[lists], self.id[lists] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1)


def _measure(references: np.ndarray, dim: int, scale: int):
    """Whole-number components, padded with zeros to one length, norms and angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            at = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(flat) and np.abs(flat).max() >= 1 << 53:
                raise OverflowError("components do not fit")
            size = np.diff(at)
            v = np.zeros((batch.num_rows, dim))
            v[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
            norms = np.sqrt((v * v).sum(axis=1))
            theta = angles(v, norms, references)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("anchor"), _blobs(v.astype("<i8")), pa.array(norms), _blobs(theta.astype("<f8"))],
                names=["id", "label", "anchor", "vec", "norm", "theta"],
            )

    return run


def _blobs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 8
    return pa.array([rows[i].tobytes() for i in range(len(rows))], pa.binary()) if width else pa.array([b""] * len(rows), pa.binary())


def _matrix(blobs: pa.Array, kind: str) -> np.ndarray:
    return _stacked([x.as_py() for x in blobs], kind)


def _stacked(rows: list[bytes], kind: str) -> np.ndarray:
    width = len(rows[0]) // 8 if rows else 0
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), width) if width else np.zeros((len(rows), 0), kind)


def _tiles(batches: Iterator[pa.RecordBatch], anchors: dict) -> Iterator[tuple]:
    """(anchors' places, row ids ascending, labels, vectors, least, largest score) of each tile."""
    for batch in batches:
        batch = batch.take(pa.array(np.argsort(batch.column("id").to_numpy(), kind="stable")))
        for k in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(k, TILE_ROWS)
            ids, labels, norms = (part.column(c).to_numpy() for c in ("id", "label", "norm"))
            vec, theta = _matrix(part.column("vec"), "<i8"), _matrix(part.column("theta"), "<f8")
            for i in range(0, len(anchors["id"]), TILE_ANCHORS):
                some = np.arange(i, min(i + TILE_ANCHORS, len(anchors["id"])))
                yield some, ids, labels, vec, *bounds(anchors["theta"][some], anchors["norm"][some], theta, norms)


def _positives(chunk, count: int):
    """The first rows of each anchor's label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = chunk.value
        best = Best(len(anchors["id"]), count)
        for some, ids, labels, vec, _, high in _tiles(batches, anchors):
            mask = (anchors["label"][some, None] == labels) & (anchors["id"][some, None] != ids) & (high >= best.last[some, None])
            best.add(some, scored(anchors["vec"][some], vec, mask), ids)
        a, k = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "score": best.score[a, k], "id": best.id[a, k]})

    return run


def _negatives(chunk, count: int, low: int, high: int, den: int):
    """The first rows in each positive's window of scores in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = chunk.value
        score, held = anchors["positive_score"], anchors["positive_id"]
        width = score.shape[1]
        best = Best(score.size, count)
        for some, ids, labels, vec, least, largest in _tiles(batches, anchors):
            other = anchors["label"][some, None] != labels
            windows = []
            for p in range(width):
                s = score[some, p, None]
                fits = (s > NONE) & other & (den * largest >= low * s.astype(float)) & (den * least <= high * s.astype(float))
                windows.append(fits & (largest >= best.last[some * width + p, None]))
            exact = scored(anchors["vec"][some], vec, np.logical_or.reduce(windows))
            for p, fits in enumerate(windows):
                # den * x >= low * s and den * x <= high * s, without products that could overflow
                s = score[some, p]
                floor = np.array([-((-low * x) // den) for x in s.tolist()], dtype=object)
                ceiling = np.array([(high * x) // den for x in s.tolist()], dtype=object)
                lo = np.array([max(x, NONE + 1) for x in floor], np.int64)
                hi = np.array([max(x, NONE) for x in ceiling], np.int64)
                inside = fits & (exact >= lo[:, None]) & (exact <= hi[:, None])
                best.add(some * width + p, np.where(inside, exact, NONE), ids)
        at, k = np.nonzero(best.score > NONE)
        a, p = at // max(width, 1), at % max(width, 1)
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(a, pa.int32()), "p": pa.array(p, pa.int32()), "anchor_id": anchors["id"][a], "positive_id": held[a, p], "negative_id": best.id[at, k],
            "positive_score": score[a, p], "negative_score": best.score[at, k],
        })

    return run


def _chunks(rows: Iterator[Row]) -> Iterator[dict]:
    """Anchors as arrays, CHUNK at a time."""
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield _arrays(held)
            held = []
    if held:
        yield _arrays(held)


def _arrays(rows: list[Row]) -> dict:
    return {
        "id": np.array([r.id for r in rows], np.int64), "label": np.array([r.label for r in rows], np.int64), "norm": np.array([r.norm for r in rows]),
        "vec": _stacked([bytes(r.vec) for r in rows], "<i8"), "theta": _stacked([bytes(r.theta) for r in rows], "<f8"),
    }


def _ranked(rows: DataFrame, keys: list[str], count: int, score: str, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, den: int = 100, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x); a row's score is its inner product with the anchor. Lists are ordered by
    score, higher first, then by smaller id. An anchor's positives are its first ``positives`` rows of its label and
    another id; for each, the first ``negatives`` rows of other labels with ``low * p <= den * n <= high * p`` for the
    scores p and n are returned. Fewer where there are fewer.

    Rows with a null id, label, vector or ``anchors`` value, or a component that is null or not finite, take no part.
    Shorter vectors are padded with zeros. Repeated rows take part as often as they stand there. Labels that are no
    numbers are compared by a 64-bit hash. Scores beyond 64 bits raise an error. No anchors give no rows.
    """
    spark = rows.sparkSession
    label = F.col(f"`{label_col}`")
    if rows.schema[label_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        label = F.when(label.isNotNull(), F.xxhash64(label))
    clean = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), anchors.alias("anchor"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")
    ).filter("id is not null and label is not null and anchor is not null and vec is not null")
    clean = clean.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"), F.count_if("anchor").alias("anchors")).first()

    first = clean.filter("anchor").orderBy("id").limit(CHOICE).select("vec").collect()  # bounded; it only decides how tight the bounds are
    drawn = np.zeros((len(first), size.dim))
    for i, row in enumerate(first):
        drawn[i, : len(row.vec)] = row.vec
    measured = clean.repartition(-(-size.n // PART) or 1).mapInArrow(_measure(directions(drawn), size.dim, scale), "id long, label long, anchor boolean, vec binary, norm double, theta binary")
    vectors = cut(measured, "zstd")
    chosen = cut(vectors.filter("anchor").drop("anchor").repartition(-(-size.anchors // CHUNK) or 1))

    path = f"{checkpoint_root(spark)}/cuts/{uuid.uuid4().hex}"
    out = "a int, p int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    shown = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    spark.createDataFrame([], out).withColumn("rank", F.lit(1)).select(shown).write.parquet(path)
    table = vectors.select("id", "label", "vec", "norm", "theta")
    for chunk in _chunks(chosen.toLocalIterator()):
        sent = spark.sparkContext.broadcast(chunk)
        near = _ranked(table.mapInArrow(_positives(sent, positives), "a int, score long, id long"), ["a"], positives, "score", "id")
        chunk["positive_score"], chunk["positive_id"] = (np.full((len(chunk["id"]), positives), x, np.int64) for x in (NONE, 0))
        for row in near.collect():  # at most ``positives`` for each anchor of the chunk
            chunk["positive_score"][row.a, row.rank - 1], chunk["positive_id"][row.a, row.rank - 1] = row.score, row.id
        wide = spark.sparkContext.broadcast(chunk)
        mined = _ranked(table.mapInArrow(_negatives(wide, negatives, low, high, den), out), ["a", "p"], negatives, "negative_score", "negative_id")
        mined.select(shown).write.mode("append").parquet(path)
        sent.unpersist()
        wide.unpersist()
    return spark.read.parquet(path)
