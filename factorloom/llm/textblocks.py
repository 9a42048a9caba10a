"""Words and hashes of many texts at once, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at_place(code: np.ndarray) -> np.ndarray:
    """What a byte adds to the hash of its word; code: its place in the word, times 256, and the byte."""
    return mix64(code.astype(np.uint64) * _PRIME + np.uint64(1))


#: The same for the first places, which nearly all bytes have.
_TABLE = _at_place(np.arange(64 << 8))


def blocks(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for consecutive texts of a string column; nulls are empty. A long text is a block alone."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block, and where each text's words begin (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]  # a text's first byte begins a word even after another's last
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    code = (within << 8) | (_LOWER[raw] if lower else raw)[at]
    # Random numbers by place and byte add up, so that no pattern of bytes makes words alike.
    values = _TABLE[np.minimum(code, len(_TABLE) - 1)]
    late = np.flatnonzero(code >= len(_TABLE))
    values[late] = _at_place(code[late])
    hashed = np.add.reduceat(values, first)
    return mix64(hashed + lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of `size` consecutive words; of all its words where it has fewer; empty without words."""
    scaled = [words * np.uint64(2 * k + 3) * _PRIME + np.uint64(k) for k in range(size)]
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        runs += mix64(scaled[k][k : n - size + 1 + k] if n >= size else scaled[k][:0])
    runs = mix64(runs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            part = np.zeros(1, dtype=np.uint64)
            for k in range(b - a):
                part += mix64(scaled[k][a + k : a + k + 1])
            yield mix64(part + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
