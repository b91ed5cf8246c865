"""Media columns: Netpbm and BMP bytes to NumPy arrays, area-resized tiles in NPY form, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W

#: Rows of an image whose integral image is held at once.
BAND = 4096
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are not a whole image of a known kind."""


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as BMP with a grey palette, rows from the bottom."""
    height, width = pixels.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    at, numbers = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _TOKEN.match(raw, at)
        if not found or not found[1].isdigit():
            raise MediaError("Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    if not 0 < top < 65536:
        raise MediaError("Netpbm maximum")
    depth = 3 if kind in (3, 6) else 1
    count = width * height * depth
    if kind == 4:
        stride = -(-width // 8)
        bits = np.frombuffer(raw, np.uint8, offset=at + 1)[: stride * height]
        if len(bits) < stride * height:
            raise MediaError("Netpbm data")
        return (1 - np.unpackbits(bits.reshape(height, stride), axis=1)[:, :width]) * np.uint8(255)
    if kind > 3:
        sample = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(raw) - at - 1 < count * sample.itemsize:
            raise MediaError("Netpbm data")
        values = np.frombuffer(raw, sample, count, at + 1)
    else:
        body = re.sub(rb"#[^\n]*", b"", raw[at:])
        digits = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if len(digits) < count:
            raise MediaError("Netpbm data")
        values = np.array(digits[:count]).astype(np.int64)
    if kind == 1:
        values = 255 * (1 - values)
    values = values.astype(np.uint16 if top > 255 else np.uint8)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise MediaError("BMP header")
    (at,) = struct.unpack_from("<I", raw, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", raw, 14)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0:
        raise MediaError("BMP kind")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if len(raw) < at + stride * rows:
        raise MediaError("BMP data")
    grid = np.frombuffer(raw, np.uint8, stride * rows, at).reshape(rows, stride)
    if bits >= 24:
        pixels = grid[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        (used,) = struct.unpack_from("<I", raw, 46)
        palette = np.frombuffer(raw, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
        unpacked = np.unpackbits(grid, axis=1).reshape(rows, -1, bits)
        index = np.packbits(np.concatenate([np.zeros((*unpacked.shape[:2], 8 - bits), np.uint8), unpacked], axis=2), axis=2)[:, :width, 0] if bits < 8 else grid[:, :width]
        pixels = palette[index]
        if (pixels[..., :1] == pixels).all():
            pixels = pixels[..., 0]
    return np.ascontiguousarray(pixels if height < 0 else pixels[::-1])


def decode(raw: bytes) -> np.ndarray:
    """Pixels (height, width) or (height, width, 3) of a Netpbm (P1 … P6) or BMP file."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise MediaError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel, by the mean."""
    return pixels if pixels.ndim == 2 else pixels.mean(axis=2)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area it covers, from sums of an integral image.

    Between pixel corners the integral image is linear, so covered fractions count exactly. Tall images are
    summed in bands, of which only the rows that bound new pixels are kept.
    """
    rows, columns = pixels.shape[:2]
    ys, xs = np.arange(height + 1) * (rows / height), np.arange(width + 1) * (columns / width)
    x0 = np.minimum(xs.astype(np.int64), columns - 1)
    fx = xs - x0
    y0 = np.minimum(ys.astype(np.int64), rows - 1)
    fy = ys - y0
    below, above = np.zeros((height + 1, width + 1)), np.zeros((height + 1, width + 1))
    carry = np.zeros(columns + 1)
    for top in range(0, rows, BAND):
        band = pixels[top : top + BAND].astype(np.float64)
        total = np.zeros((len(band) + 1, columns + 1))
        np.cumsum(np.cumsum(band, axis=0), axis=1, out=total[1:, 1:])
        total += carry
        across = total[:, x0] * (1 - fx) + total[:, x0 + 1] * fx
        own = (y0 >= top) & (y0 < top + len(band))
        below[own], above[own] = across[y0[own] - top], across[y0[own] - top + 1]
        carry = total[-1]
    corner = below * (1 - fy)[:, None] + above * fy[:, None]
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums / ((rows / height) * (columns / width))


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """Bits of whether each of size x size cells is darker than its right neighbour, as hex."""
    cells = area_resize(pixels, size, size + 1)
    return np.packbits(cells[:, :-1] < cells[:, 1:] - 1e-9).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _store(kind: str, unit: int):
    form = {"pgm": encode_pgm, "bmp": encode_bmp}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "text"):
                data, at = W.strings(rows.column("text"))
                media = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    pixels = np.zeros(max(1, -(-(b - a) // unit)) * unit, dtype=np.uint8)
                    pixels[: b - a] = data[a:b]
                    media.append(form(pixels.reshape(-1, unit)))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return run


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "pgm", unit: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of ``unit``,
    as a grey image of that width. Nulls count as empty texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store(kind, unit), f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def _measure(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "media"):
                out: dict[str, list] = {k: [] for k in ("error", "height", "width", "pixel_bytes", "pixel_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash")}
                for value in rows.column("media"):
                    raw = value.as_py() or b""
                    try:
                        pixels, error = decode(raw), None
                        if not pixels.size:
                            raise MediaError("no pixels")
                    except MediaError as why:
                        pixels, error = None, str(why)
                    out["error"].append(error)
                    out["media_bytes"].append(len(raw))
                    out["media_sha256"].append(hashlib.sha256(raw).hexdigest())
                    if pixels is None:
                        for k in ("height", "width", "pixel_bytes", "pixel_sha256", "tail_crc32", "tile", "dhash"):
                            out[k].append(None)
                        continue
                    body = pixels.tobytes()
                    one = grey(pixels)
                    out["height"].append(pixels.shape[0])
                    out["width"].append(pixels.shape[1])
                    out["pixel_bytes"].append(len(body))
                    out["pixel_sha256"].append(hashlib.sha256(body).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(body[-64:]))
                    out["tile"].append(npy(np.rint(area_resize(one, tile, tile)).astype(np.uint16 if pixels.dtype == np.uint16 else np.uint8)))
                    out["dhash"].append(difference_hash(one))
                types = {"error": pa.string(), "pixel_sha256": pa.string(), "media_sha256": pa.string(), "dhash": pa.string(), "tile": pa.binary()}
                names = [n for n in rows.schema.names if n != "media"]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(n) for n in names] + [pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=names + list(out)
                )

    return run


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id", "n_bytes"), tile: int = 16) -> DataFrame:
    """Decodes a column of Netpbm or BMP bytes: digests of the pixels, an NPY tile and a difference hash.

    Adds error (null, or why the bytes are no image; then the pixel columns are null), height, width,
    pixel_bytes, pixel_sha256, tail_crc32 (of the last 64 pixel bytes), media_bytes, media_sha256, tile (NPY bytes of
    a tile x tile array) and dhash. Null counts as no bytes.
    """
    types = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{types}, error string, height long, width long, pixel_bytes long, pixel_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string"
    return media.select(*keep, F.col(media_col).alias("media")).mapInArrow(_measure(tile), schema)

