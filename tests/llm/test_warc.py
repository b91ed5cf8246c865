"""WARC archives: round trips, damage, repeated payloads and odd rows."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from balanza.llm import warc as A


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(body, size):
    assert A.dechunk(A.chunked(body, size)) == body


def test_chunk_extensions_trailers_and_damage():
    assert A.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            A.dechunk(bad)


def test_segments_join_in_any_order_and_are_checked():
    block = bytes(range(256)) * 3
    made = list(A.segments("urn:x", {"WARC-Type": "response"}, block, 100))
    assert len(made) == 8 and made[-1][0]["WARC-Segment-Total-Length"] == str(len(block))
    pieces = [{"segment": int(f["WARC-Segment-Number"]), "block": b} for f, b in made]
    assert A.join_segments(pieces[::-1], len(block)) == block
    for some, total in ((pieces[:-1], len(block)), (pieces[1:], len(block)), (pieces + pieces[:1], len(block)), (pieces, 5), (pieces, None)):
        with pytest.raises(ValueError):
            A.join_segments(some, total)


def tables(spark, rows, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    manifest = A.write_archives(frame, **options)
    return A.read_records(manifest)


ROWS = [
    (5, "http://a/é?x=1", "<p>" + "long text " * 40, "clash"), (3, None, "<p>" + "long text " * 40, None), (9, "u", "<p>" + "long text " * 40, None),
    (1, "u", None, None), (2, "u", "", None), (4, "u", "short", None), (6, "u", "short", None), (7, "u\r\nX: y", "ünï" * 20000, None),
    (None, "u", "<p>" + "long text " * 40, None), (8, "u", "other " * 30, None), (8, "u", "other " * 30, None), (10, "u", "HTTP/1.1\r\n\r\n0\r\n\r\n" * 9, None),
]


def expected(rows):
    low = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            low[h] = min(low.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        first = low.get(h)
        revisit = first is not None and first != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_rows_come_back(spark):
    for options in ({}, {"segment_bytes": 150, "archive_bytes": 2000}):
        got = A.page_table(A.reassemble(tables(spark, ROWS, **options))).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == expected(ROWS)
        assert all(r.error is None for r in got)


def test_payloads_and_lost_segments(spark):
    records = tables(spark, ROWS, segment_bytes=150).cache()
    whole = A.reassemble(records, with_payload=True).filter("type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in whole) == sorted(r[2] or "" for r, e in zip(sorted(ROWS, key=str), expected(ROWS)) if e[3] == "response")
    damaged = A.reassemble(records.filter("segment is null or segment <> 2")).filter("error is not null")
    assert damaged.count() == records.filter("segment = 2").count() > 0
    headless = A.reassemble(records.filter("segment is null or segment <> 1")).filter("error is not null")
    assert headless.count() == records.filter("segment = 1").count()


def test_no_rows(spark):
    assert A.page_table(A.reassemble(tables(spark, []))).count() == 0
