"""WARC archives: written in segments, read back by reassembling continuation records.

Payloads are HTTP responses in chunked transfer framing. A block longer than the segment size is cut: a first
record, then continuation records that name it by WARC-Segment-Origin-ID and carry a segment number, the last
with the total length. Equal payloads are stored once; the others are revisit records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W
from balanza.llm.files import attempt, new_folder, one_task_each, open_folder
from balanza.session import cut

SEGMENT_BYTES = 1 << 15
ARCHIVE_BYTES = 1 << 26
CHUNK_BYTES = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The content of a chunked body; extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("chunk size is no number") from None
        at = end + 2
        if size < 0 or at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n" and size:
            raise ValueError("chunk is cut off")
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header is cut off")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def segments(name: str, fields: dict[str, str], block: bytes, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a block: one, or a first and its continuations."""
    if len(block) <= size:
        yield fields, block
        return
    count = -(-len(block) // size)
    for i in range(count):
        own = dict(fields, **{"WARC-Segment-Number": "1"}) if i == 0 else {
            "WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{i + 1}>", "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": str(i + 1),
            **({"WARC-Segment-Total-Length": str(len(block))} if i == count - 1 else {}),
        }
        yield own, block[i * size : (i + 1) * size]


def _write(folder: str, segment: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        part, tries = attempt()
        out, path, size, records, serial, row = None, "", 0, 0, 0, 0
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{path.rsplit('/', 1)[1]}", records, size))
                out = None

        def put(fields: dict[str, str], block: bytes) -> None:
            nonlocal out, path, size, records, serial
            if out is not None and size >= archive:
                close()
            if out is None:
                path = f"{root}/part-{part:06d}-{serial:05d}-{tries}.warc.gz"
                out, serial, records = fs.open_output_stream(path, compression=None), serial + 1, 0
                head = record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{part}.{serial}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                out.write(head)
                size = len(head)
            body = record(fields, block)
            out.write(body)
            size += len(body)
            records += 1

        for batch in batches:
            for rows in W.slices(batch, "html"):
                columns = [rows.column(c).to_pylist() for c in ("key", "url", "html", "digest", "refers")]
                for key, url, html, digest, refers in zip(*columns, strict=True):
                    name = f"urn:page:{quote(key, safe='')}:{part}.{row}"
                    row += 1
                    fields = {
                        "WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE,
                        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%") if url else "urn:none",
                        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response",
                    }
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    if refers is None:
                        block = http + chunked((html or "").encode())
                    else:
                        fields |= {"WARC-Refers-To": f"<urn:page:{quote(refers, safe='')}>", "WARC-Profile": PROFILE}
                        block = http
                    for own, piece in segments(name, fields, block, segment):
                        put(own, piece)
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": pa.array([d[1] for d in done], pa.int64()), "n_bytes": pa.array([d[2] for d in done], pa.int64())})

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row and returns the manifest (path, records, n_bytes) of the archives.

    Of rows with equal payloads of at least ``least`` bytes, those of the smallest id are responses, the others
    revisits of it; a null id is never the smallest, and is a response only if all ids are null. Rows that repeat
    an id and a payload are written as often. Revisits name the page (urn:page:ID) of their response; its record
    ids add where it was written, so that repeated rows stay apart. Null html is an empty payload.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = cut(shared.select("digest", "low"))
    refers = F.when(F.col("low").isNotNull() & ~F.col("id").eqNullSafe(F.col("low")), F.col("low").cast("string"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null"))
    named = rows.join(shared, "digest", "left").select(key.alias("key"), "url", "html", "digest", F.concat(F.lit("="), refers).alias("refers"))
    made = named.mapInArrow(_write(new_folder(pages.sparkSession, "warc"), segment_bytes, archive_bytes), "path string, records long, n_bytes long")
    return cut(made)


def members(uri: str) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        unpack, parts, data = zlib.decompressobj(31), [], b""
        while True:
            data = data or f.read(1 << 20)
            if not data:
                if parts:
                    raise ValueError(f"{uri} is cut off")
                return
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                data = unpack.unused_data
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(body) < size:
        raise ValueError("record is cut off")
    return fields, body[:size]


RECORD = "record_id string, type string, origin string, segment int, total long, refers string, uri string, digest string, block binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "origin", "segment", "total", "refers", "uri", "digest", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            held, size = [], 0
            for raw in members(path):
                f, block = parse(raw)
                if f["warc-type"] == "warcinfo":
                    continue
                number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                held.append((
                    f["warc-record-id"].strip("<>"), f["warc-type"], f.get("warc-segment-origin-id", "").strip("<>") or None,
                    int(number) if number else None, int(total) if total else None, f.get("warc-refers-to", "").strip("<>") or None,
                    f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, block,
                ))
                size += len(block)
                if size >= W.SLICE or len(held) >= 10_000:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()


def read_records(manifest: DataFrame) -> DataFrame:
    """All records of the archives but their info records."""
    return one_task_each(manifest.select("path")).mapInArrow(_records, RECORD)


def join_segments(pieces: list[dict], total: int | None) -> bytes:
    """The block of segments in any order; raises if one is missing or repeated, or the length is wrong."""
    pieces = sorted(pieces, key=lambda p: p["segment"])
    if [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(p["block"] for p in pieces)
    if total is None or len(block) != total:
        raise ValueError("total length differs")
    return block


def _decode(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            n_bytes, digests, errors, bodies = [], [], [], []
            for kind, pieces, total, segmented, stated in zip(*(batch.column(c).to_pylist() for c in ("type", "pieces", "total", "segmented", "digest")), strict=True):
                body, error = None, None
                try:
                    if kind is None:
                        raise ValueError("first segment is missing")
                    if kind != "revisit":
                        body = payload_of(join_segments(pieces, total) if segmented else pieces[0]["block"])
                        if stated is not None and hashlib.sha256(body).hexdigest() != stated:
                            raise ValueError("payload digest differs")
                except ValueError as why:
                    body, error = None, str(why)
                n_bytes.append(None if body is None else len(body))
                digests.append(None if body is None else hashlib.sha256(body).hexdigest())
                errors.append(error)
                bodies.append(body)
            columns = [batch.column(c) for c in ("record_id", "type", "refers", "uri", "digest")]
            columns += [pa.array(n_bytes, pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string())]
            names = ["record_id", "type", "refers", "uri", "stated", "n_bytes", "sha256", "error"]
            if with_payload:
                columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def reassemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """(record_id, type, refers, uri, stated, n_bytes, sha256, error[, payload]) of every whole record.

    Continuation records are grouped by their origin's id, ordered by segment number and checked against the total
    length; then HTTP headers and chunked framing are taken off. A record with missing, repeated or damaged
    parts, or with another digest than it states, stays as a row with its error and no payload. Revisits have
    none. A group holds the segments of one record, and records without segments are not grouped at all.
    """
    piece = F.struct(F.col("segment"), F.col("block"))
    single = records.filter("segment is null").select("record_id", "type", "refers", "uri", "digest", F.array(piece).alias("pieces"), "total", F.lit(False).alias("segmented"))
    is_first = F.col("segment") == 1
    grouped = records.filter("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(is_first, F.col(c))).alias(c) for c in ("type", "refers", "uri", "digest")],
        F.collect_list(piece).alias("pieces"), F.max("total").alias("total"), F.lit(True).alias("segmented"),
    )
    whole = single.unionByName(grouped)
    schema = "record_id string, type string, refers string, uri string, stated string, n_bytes long, sha256 string, error string" + (", payload binary" if with_payload else "")
    return whole.mapInArrow(_decode(with_payload), schema)


def page_table(whole: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of the records that ``write_archives`` wrote.

    A revisit takes length and digest from the response it refers to, whose digest must be the one it states.
    """

    def page(name: str):
        text = F.regexp_extract(name, r"^urn:page:([^:]*)", 1)
        return F.when(text.startswith("%3D"), F.url_decode(F.substring(text, 4, 1 << 30))).cast(id_type)

    rows = cut(whole.select(
        page("record_id").alias("page_id"), F.col("type").alias("record_type"), page("refers").alias("refers_to"),
        F.col("n_bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "stated", "error",
    ))
    responses = rows.filter("record_type = 'response' and error is null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("full"))
    found = rows.filter("record_type = 'revisit'").join(responses, ["refers_to", "stated"], "left").select(
        "page_id", F.col("full").alias("payload_bytes"), F.when(F.col("full").isNotNull(), F.col("stated")).alias("payload_digest"), "record_type", "refers_to",
        F.coalesce("error", F.when(F.col("full").isNull(), F.lit("response is missing"))).alias("error"),
    )
    return rows.filter("record_type is null or record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").union(found)
