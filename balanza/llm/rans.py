"""Static range asymmetric numeral system over integer symbols, in NumPy.

Symbols are coded in blocks of their own. Within a block, symbol i belongs to lane i modulo the number of
lanes; every lane has its own 64-bit state and its own 32-bit words, so all lanes of all blocks of a file
are coded in step. A block decodes alone from its checkpoint (offset, first symbol, lane states).
"""

from __future__ import annotations

import numpy as np

LANES = 64
BLOCK = 1 << 16
_LOW = np.uint64(1 << 31)


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Integer frequencies of sum 2^bits for positive counts, none below 1."""
    total, room = int(counts.sum()), 1 << bits
    if not len(counts):
        return np.zeros(0, np.uint32)
    freq = np.maximum(1, (counts.astype(np.float64) * (room / total)).astype(np.int64))
    over = int(freq.sum()) - room
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest, in proportion
        for i in order:
            cut = min(over, max(0, int(freq[i]) // 8) or int(freq[i] > 1))
            freq[i] -= cut
            over -= cut
            if over <= 0:
                break
    freq[order[0]] -= over
    return freq.astype(np.uint32)


def table_bits(symbols: int) -> int:
    """Bits that leave each of so many symbols at least four of the table's places."""
    return max(12, int(max(1, symbols) - 1).bit_length() + 2)


class Table:
    """Frequencies of a sorted symbol list; symbols are coded as their index in it."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1 if len(freq) else 0

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def _active(t: int, sizes: np.ndarray, lanes: int) -> int | None:
    """How many of the last block's lanes have a symbol at step t; None for all."""
    left = int(sizes[-1]) - t * lanes
    return None if left >= lanes else max(0, left)


def encode(index: np.ndarray, table: Table, block: int = BLOCK, lanes: int = LANES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block (states, words per lane, words), of symbol indices in order."""
    n = len(index)
    if not n:
        return []
    blocks = -(-n // block)
    steps = -(-min(n, block) // lanes)
    grid = np.zeros((blocks, -(-block // lanes) * lanes if blocks > 1 else steps * lanes), dtype=np.int32)
    flat = grid.shape[1]
    for b in range(blocks):
        part = index[b * block : (b + 1) * block]
        grid[b, : len(part)] = part
    sizes = np.array([min(block, n - b * block) for b in range(blocks)])
    grid = grid.reshape(blocks, flat // lanes, lanes).transpose(1, 0, 2).reshape(flat // lanes, blocks * lanes)
    grid = np.ascontiguousarray(grid)
    width = blocks * lanes
    state = np.full(width, _LOW, dtype=np.uint64)
    words = np.zeros((grid.shape[0], width), dtype=np.uint32)
    sent = np.zeros((grid.shape[0], width), dtype=bool)
    k = np.uint64(table.bits)
    top = np.uint64(63 - table.bits)
    low32, shift32 = np.uint64(0xFFFFFFFF), np.uint64(32)
    for t in range(grid.shape[0] - 1, -1, -1):
        some = _active(t, sizes, lanes)
        end = width if some is None else width - lanes + some
        x = state[:end]
        s = grid[t, :end]
        f = table.freq[s]
        full = x >= (f << top)
        if table.bits == 0:
            full = np.zeros(end, dtype=bool)
        words[t, :end] = (x & low32).astype(np.uint32)
        sent[t, :end] = full
        x = np.where(full, x >> shift32, x)
        q = x // f
        state[:end] = (q << k) + (x - q * f) + table.start[s]
    out = []
    for b in range(blocks):
        own = slice(b * lanes, (b + 1) * lanes)
        mask = sent[:, own].T
        out.append((state[own].copy(), mask.sum(axis=1).astype(np.uint32), words[:, own].T[mask]))
    return out


def decode(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], table: Table, block: int = BLOCK, lanes: int = LANES) -> list[np.ndarray]:
    """Symbol indices of each block, from (states, words per lane, words, symbols).

    Blocks may come from anywhere in a file; those of equal size are decoded in step.
    """
    out: list[np.ndarray | None] = [None] * len(parts)
    slots = table.slots()
    by_size: dict[int, list[int]] = {}
    for i, part in enumerate(parts):
        by_size.setdefault(part[3], []).append(i)
    k, mask, shift32 = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    for size, group in by_size.items():
        steps = -(-size // lanes)
        last = size - (steps - 1) * lanes
        state = np.concatenate([parts[i][0] for i in group]).astype(np.uint64)
        words = np.concatenate([parts[i][2] for i in group] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.cumsum(np.concatenate([[0], np.concatenate([parts[i][1] for i in group]).astype(np.int64)]))[:-1]
        got = np.zeros((steps, len(group) * lanes), dtype=np.uint32)
        held = None
        for t in range(steps):
            if t == steps - 1 and last < lanes:
                held = np.flatnonzero(np.arange(len(group) * lanes) % lanes < last)
            x = state if held is None else state[held]
            slot = (x & mask).astype(np.int64)
            s = slots[slot]
            x = table.freq[s] * (x >> k) + slot.astype(np.uint64) - table.start[s]
            need = x < _LOW
            if table.bits and need.any():
                place = at if held is None else at[held]
                x = np.where(need, (x << shift32) | words[np.minimum(place, len(words) - 1)], x)
                if held is None:
                    at = at + need
            if held is None:
                state = x
                got[t] = s
            else:
                got[t, held] = s
        grid = got.reshape(steps, len(group), lanes).transpose(1, 0, 2).reshape(len(group), steps * lanes)
        for row, i in enumerate(group):
            out[i] = grid[row, :size]
    return out
