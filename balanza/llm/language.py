"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A model holds, for each language, log-likelihoods of byte trigrams and of whole words (both hashed to tables of
fixed size) and the scripts it is written in. A word is scored for the languages of its script only.
Changing the language between two words costs a fixed penalty, so single borrowed words don't make spans.
A text's language is the one whose spans hold most letters' bytes; the score is its share of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W
from balanza.session import cut

TABLE_BITS = 18
#: Labelled documents of each language that the model is fitted on, about; chosen by the hash of their ids.
SAMPLE_DOCS = 5000
SWITCH_PENALTY = 12.0
UNDETERMINED = "und"

# First code points of ranges of letters by script (Unicode blocks); 0 is no letter of a known
# script, and ASCII letters are Latin.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "hangul", "kana", "han")
RANGES = (
    (0x00, "none"), (0xAA, "latin"), (0xAB, "none"), (0xBA, "latin"), (0xBB, "none"), (0xC0, "latin"), (0xD7, "none"), (0xD8, "latin"),
    (0xF7, "none"), (0xF8, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x700, "none"), (0x750, "arabic"), (0x780, "none"), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, "none"), (0xB80, "tamil"), (0xC00, "none"), (0xE00, "thai"), (0xE80, "none"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "none"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "none"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x3041, "kana"), (0x3100, "none"), (0x3130, "hangul"), (0x3190, "none"), (0x31F0, "kana"), (0x3200, "none"), (0x3400, "han"),
    (0x4DC0, "none"), (0x4E00, "han"), (0xA000, "none"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"), (0xFE70, "arabic"), (0xFF00, "none"), (0xFF21, "latin"),
    (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "none"), (0x20000, "han"), (0x32000, "none"),
)
_FROM = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(b) for _, b in RANGES], dtype=np.uint8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Words are runs of ASCII letters and of all non-ASCII characters.
WORDS = _LETTER.copy()
WORDS[128:] = True


@dataclass
class Model:
    langs: list[str]
    trigram: np.ndarray  # (table, language)
    word: np.ndarray
    scripts: np.ndarray  # (script, language): written in it
    penalty: float = SWITCH_PENALTY


def script_of(data: np.ndarray) -> np.ndarray:
    """The script of each character, at its first byte; 0 elsewhere."""
    out = np.zeros(len(data), dtype=np.uint8)
    out[_LETTER[data]] = 1
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (wide[lead + i] for i in range(4))
        two = ((b0 & 31) << 6) | (b1 & 63)
        three = ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)
        four = ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)
        point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        out[lead] = _SCRIPT[np.searchsorted(_FROM, point, side="right") - 1]
    return out


def _pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (W.PIECE >> 1), side="right")))
        yield i, j
        i = j


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For some neighbouring words: trigram cells of all their bytes, each word's first place among these,
    the words' cells, and the words' scripts (of their first letter; 0 for no letter)."""
    lo, hi = int(starts[0]), int(ends[-1])
    part = W.LOWER[data[lo:hi]]
    inside = np.zeros(hi - lo + 1, dtype=np.int8)
    inside[starts - lo] = 1
    np.add.at(inside, ends - lo, -1)
    mask = np.cumsum(inside[:-1]).astype(bool)
    shown = np.where(mask, part, 32).astype(np.uint32)
    # two words may touch at a row's border: neighbours outside the word count as blanks
    before, after = np.concatenate([[32], shown[:-1]]).astype(np.uint32), np.concatenate([shown[1:], [32]]).astype(np.uint32)
    before[starts - lo], after[ends - lo - 1] = 32, 32
    tri = ((before << 16) | (shown << 8) | after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = (tri >> np.uint64(64 - TABLE_BITS)).astype(np.int64)[mask]
    size = ends - starts
    first = np.cumsum(size) - size
    whole = (W.span_hashes(data, starts, ends) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    script = script_of(data[lo:hi])[mask]
    # the first character with a script: the least position where it is not 0
    spot = np.flatnonzero(script)
    at = np.searchsorted(spot, first)
    ok = at < len(spot)
    ok[ok] &= spot[at[ok]] < (first + size)[ok]
    kinds = np.zeros(len(starts), dtype=np.uint8)
    kinds[ok] = script[spot[at[ok]]]
    return cells, first, whole, kinds


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(word, language) scores about a mean of 0, and the words' scripts."""
    scores = np.zeros((len(starts), len(model.langs)), dtype=np.float32)
    kinds = np.zeros(len(starts), dtype=np.uint8)
    for i, j in _pieces(starts, ends):
        cells, first, whole, kinds[i:j] = features(data, starts[i:j], ends[i:j])
        part = np.add.reduceat(model.trigram[cells], first, axis=0) + model.word[whole]
        part -= part.mean(axis=1, keepdims=True)
        allowed = model.scripts[kinds[i:j]]
        some = allowed.any(axis=1)
        part[~some] = 0
        part[some[:, None] & ~allowed] = -1000.0
        scores[i:j] = part
    scores[kinds == 0] = 0
    return scores, kinds


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, rows in step; ``first`` has each row's first word and the end."""
    n, langs = scores.shape
    out = np.zeros(n, dtype=np.int16)
    size = np.diff(first)
    rows = np.argsort(-size, kind="stable")
    rows = rows[size[rows] > 0]
    if not len(rows) or langs == 1:
        return out
    begin, size = first[:-1][rows], size[rows]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # rows longer than each step
    stay = np.zeros((n, langs), dtype=bool)
    source = np.zeros(n, dtype=np.int16)
    value = scores[begin].astype(np.float64)
    final = np.zeros(len(rows), dtype=np.int16)
    for t in range(1, steps):
        k = active[t]
        if k < len(value):
            final[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        at = begin[:k] + t
        best = value.argmax(axis=1)
        moved = value[np.arange(k), best] - penalty
        keep = value >= moved[:, None]
        stay[at], source[at] = keep, best
        value = np.where(keep, value, moved[:, None]) + scores[at]
        if t % 1024 == 0:
            value -= value.max(axis=1, keepdims=True)
    final[: len(value)] = value.argmax(axis=1)
    state = np.zeros(0, dtype=np.int16)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if k > len(state):
            state = np.concatenate([state, final[len(state) : k]])
        at = begin[:k] + t
        out[at] = state
        if t:
            state = np.where(stay[at, state], state, source[at])
    return out


def _count(langs: list[str]):
    """Per language: trigram and word counts, letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (2 << TABLE_BITS) + len(SCRIPTS)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in W.slices(batch, "text", 1 << 20):
                names = np.array(rows.column("lang").to_pylist(), dtype=object)
                for lang in set(names.tolist()):
                    part = rows.filter(pa.array(names == lang))
                    data, at = W.strings(part.column("text"))
                    starts, ends, _ = W.word_bounds(data, at, WORDS)
                    sums = total.setdefault(lang, np.zeros(size, dtype=np.int64))
                    for i, j in _pieces(starts, ends):
                        cells, _, whole, kinds = features(data, starts[i:j], ends[i:j])
                        sums[: 1 << TABLE_BITS] += np.bincount(cells, minlength=1 << TABLE_BITS)
                        sums[1 << TABLE_BITS : 2 << TABLE_BITS] += np.bincount(whole, minlength=1 << TABLE_BITS)
                        sums[2 << TABLE_BITS :] += np.bincount(kinds, minlength=len(SCRIPTS))
        for lang, sums in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    return run


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, penalty: float = SWITCH_PENALTY) -> Model:
    """A model from labelled texts; rows without text or label are left out.

    About ``sample_docs`` documents of each language are used, chosen by the hash of their ids.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((len(SCRIPTS), 0), dtype=bool), penalty)
    share = F.create_map([F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    chance = (F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    sample = rows.filter(chance < share[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = cut(sample.mapInArrow(_count(langs), "lang string, counts binary"))
    sums = {lang: np.zeros((2 << TABLE_BITS) + len(SCRIPTS), dtype=np.int64) for lang in langs}
    for row in parts.toLocalIterator():  # tables of fixed size
        sums[row.lang] += np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)

    def logs(a: int, b: int, smooth: float) -> np.ndarray:
        counts = np.stack([sums[lang][a:b] for lang in langs], axis=1).astype(np.float64) + smooth
        return np.log(counts / counts.sum(axis=0)).astype(np.float32)

    letters = np.stack([sums[lang][2 << TABLE_BITS :] for lang in langs], axis=1).astype(np.float64)
    letters[0] = 0
    scripts = letters >= np.maximum(1, 0.01 * letters.sum(axis=0))
    scripts[0] = False
    return Model(langs, logs(0, 1 << TABLE_BITS, 0.5), logs(1 << TABLE_BITS, 2 << TABLE_BITS, 0.5), scripts, penalty)


def label_rows(data: np.ndarray, at: np.ndarray, model: Model) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
    """(language, score) of each row, the words' languages and each row's first word."""
    starts, ends, first = W.word_bounds(data, at, WORDS)
    scores, kinds = word_scores(data, starts, ends, model)
    best = viterbi(scores, first, model.penalty)
    weight = np.where(model.scripts[kinds].any(axis=1), ends - starts, 0)  # no letters: no script is allowed
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(model.langs)
    votes = np.bincount(row * n + best, weights=weight, minlength=(len(first) - 1) * n).reshape(-1, n)
    letters = np.bincount(row, weights=np.where(kinds > 0, ends - starts, 0), minlength=len(first) - 1)
    sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = sums[at[1:]] > sums[at[:-1]]  # has an ASCII letter
    langs, shares = [], []
    for r in range(len(first) - 1):
        if not plain[r] and not any(map(str.isalpha, data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"))):
            langs.append(UNDETERMINED), shares.append(0.0)
            continue
        top = int(votes[r].argmax())
        langs.append(model.langs[top])
        shares.append(float(votes[r, top] / letters[r]) if letters[r] else 0.0)
    return langs, shares, best, first


def _detect(shared, spans: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in W.slices(batch, "text"):
                data, at = W.strings(rows.column("text"))
                if not model.langs:
                    langs, shares, best, first = [UNDETERMINED] * rows.num_rows, [0.0] * rows.num_rows, np.zeros(0, np.int16), np.zeros(rows.num_rows + 1, np.int64)
                else:
                    langs, shares, best, first = label_rows(data, at, model)
                columns = [rows.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
                names = keep + ["lang_pred", "score"]
                if spans:
                    found = []
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                        own = best[a:b]
                        edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b - a] if b > a else [0]
                        found.append([{"begin": x, "end": y, "lang": model.langs[own[x]]} for x, y in zip(edge[:-1], edge[1:], strict=True)])
                    columns.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                    names = names + ["spans"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def detect_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score[, spans]) for every row, with the columns of ``keep``.

    Null texts and texts without a letter are ``und`` with score 0. Letters of a script that no learned
    language is written in say nothing: a text of such letters alone gets some language with score 0.
    Spans are runs of words (ASCII letters and non-ASCII characters) by their numbers from 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = {"text" if c == text_col else f"k{i}": c for i, c in enumerate((id_col, *keep))}
    source = docs.select(*[F.col(c).alias(k) for k, c in kept.items() if k != "text"], F.col(text_col).alias("text"))
    types = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in kept.items()]
    schema = ", ".join([*types, "lang_pred string", "score double", *(["spans array<struct<begin:long,end:long,lang:string>>"] if spans else [])])
    found = source.mapInArrow(_detect(shared, spans, list(kept)), schema)
    return found.select(*[F.col(k).alias(c) for k, c in kept.items()], "lang_pred", "score", *(["spans"] if spans else []))
