"""Media columns: formats against hand-made bytes, resizing against a direct sum, the query against Python."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from balanza.llm import media as M
from balanza.llm.queries import QUERIES


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 70), st.integers(0, 2**32 - 1))
def test_grey_round_trips(height, width, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)
    for form in (M.encode_pgm, M.encode_bmp):
        assert np.array_equal(M.decode(form(pixels)), pixels)


def test_all_netpbm_kinds():
    assert M.decode(b"P1\n# a comment\n3 2\n1 0 1\n010\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P4 3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P2 2 1 # max\n9 3 7").tolist() == [[3, 7]]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P6 1 2 255\n\x01\x02\x03\x0a\x20\x23").tolist() == [[[1, 2, 3]], [[10, 32, 35]]]
    assert M.decode(b"P5 1 1 1000\n\x03\xe8").tolist() == [[1000]]


def test_other_bmp_kinds():
    def bmp(bits, width, height, rows, palette=b""):
        at = 54 + len(palette)
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + rows

    assert M.decode(bmp(24, 1, 2, b"\x03\x02\x01\0\x06\x05\x04\0")).tolist() == [[[4, 5, 6]], [[1, 2, 3]]]
    assert M.decode(bmp(32, 1, -1, b"\x03\x02\x01\xff")).tolist() == [[[1, 2, 3]]]
    assert M.decode(bmp(1, 3, 1, b"\xa0\0\0\0", b"\0\0\0\0\xff\xff\xff\0")).tolist() == [[255, 0, 255]]
    assert M.decode(bmp(4, 3, 1, b"\x01\x20\0\0", b"\0\0\0\0\x01\x02\x03\0\x09\x09\x09\0")).tolist() == [[[0, 0, 0], [3, 2, 1], [9, 9, 9]]]


@pytest.mark.parametrize("raw", [b"", b"P5", b"P5 4 4 255\n\x01", b"P5 a 4 255\n", b"BM", b"GIF89a", b"P2 2 2 255 1 2 3", b"P5 1 1 0\n\x01"])
def test_damage_is_named(raw):
    with pytest.raises(M.MediaError):
        M.decode(raw)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 13), st.integers(1, 13), st.integers(1, 9), st.integers(1, 9), st.integers(0, 9999))
def test_area_resize_is_the_mean_of_covered_areas(h, w, height, width, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)

    def cover(n, m):  # (new, old): how much of each old cell a new one covers
        a, b = np.arange(m)[:, None] * n / m, np.arange(1, m + 1)[:, None] * n / m
        return np.clip(np.minimum(b, np.arange(1, n + 1)) - np.maximum(a, np.arange(n)), 0, None) * m / n

    assert np.allclose(M.area_resize(pixels, height, width), cover(h, height) @ pixels @ cover(w, width).T)


def test_bands_do_not_show(monkeypatch):
    pixels = np.random.default_rng(3).integers(0, 256, (100, 7)).astype(np.uint8)
    whole = M.area_resize(pixels, 9, 5)
    monkeypatch.setattr(M, "BAND", 8)
    assert np.allclose(M.area_resize(pixels, 9, 5), whole)


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op1_media_columns"](spark, sf_dir).collect()}
    for row in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        raw = row["text"].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        form = M.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        r = got[row["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x", 0), (4, "é" * 70000, 0), (4, "é" * 70000, 0), (5, "y" * 64, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, height int")
    got = M.media_features(M.texts_to_media(docs, kind="bmp")).collect()
    assert sorted(str((r.id, r.n_bytes, r.pixel_bytes)) for r in got) == sorted(str(x) for x in [(1, 0, 64), (2, 0, 64), (None, 1, 64), (4, 140000, 140032), (4, 140000, 140032), (5, 64, 64)])
    assert np.load(io.BytesIO(got[0].tile)).shape == (16, 16)
    assert len({r.dhash for r in got if r.id == 4}) == 1
    assert M.texts_to_media(docs.limit(0)).count() == 0
    bad = M.media_features(spark.createDataFrame([(1, 1, bytearray(b"GIF")), (2, 1, None)], "id long, n_bytes long, media binary")).collect()
    assert all(r.error and r.pixel_bytes is None and r.dhash is None for r in bad)
