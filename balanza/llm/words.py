"""Words and their hashes for many texts at once, on the bytes of an Arrow string column.

A word is a run of word bytes; every delimiter is an ASCII byte, so UTF-8 never needs decoding. A
word's 64-bit hash comes from a polynomial over its (lower-cased) bytes, taken from one running sum
for the whole buffer. Work arrays are bounded by ``PIECE`` bytes of text, except for one longer word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
SLICE = 1 << 21
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_libc = ctypes.CDLL(None)


def byte_class(delimiters: bytes) -> np.ndarray:
    """256 flags: true for the bytes that belong to words."""
    flags = np.ones(256, dtype=bool)
    flags[list(delimiters)] = False
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but ASCII white space.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters and digits and all non-ASCII characters.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64, kept between calls for usual sizes."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size <= 2 * PIECE:
            _powers[key] = have
    return have[:n]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives freed memory back to the system, so that idle workers don't hold what a task has used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of at most ``limit`` text bytes, or one row."""
    if not batch.num_rows:
        return
    _, at = strings(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def word_bounds(data: np.ndarray, at: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the end as last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = flags[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        piece = data[base : int(ends[j - 1])]
        piece = (LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * _pow(_R, len(piece)), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _pow(_RINV, len(piece))[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        i = j
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each position that has them, over row borders too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out + np.uint64(n))


def gram_sets(data: np.ndarray, at: np.ndarray, n: int, flags: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """For each row its distinct n-grams, sorted; a row of fewer words is one gram, an empty row none."""
    starts, ends, first = word_bounds(data, at, flags)
    hashes = span_hashes(data, starts, ends)
    full = grams(hashes, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            yield grams(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
