"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Everything here
works on whole texts, a slice of rows at a time, so that the memory of a task
depends on the slice and on its longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

_BASE = U(0x9E3779B97F4A7C15 // 8 * 8 + 5)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, SLICE_BYTES), base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    rows = len(column)
    if rows == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes and word offsets per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> None:
        base = offsets[0]
        self.data = data[base : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        edges = offsets - base
        inside = ~_SPACE[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = edges[:-1][edges[:-1] < len(self.data)]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = edges[1:][edges[1:] > 0] - 1
        ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.start, edges)
        self.inside = inside
        self.hash = self._hashes() if hashed else np.zeros(0, np.uint64)

    def _hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * up[:n], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hash of the `width` words from each word on; starts too near the end of all words are left out."""
        if len(self.hash) < width:
            return np.zeros(0, np.uint64)
        return sequence_hash(self.hash, width)


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of `width` consecutive hashes."""
    n = len(hashes) - width + 1
    total = np.full(n, U(width * 0x51ED27F5 + 1), np.uint64)
    for i in range(width):
        total *= _BASE
        total += hashes[i : i + n]
    return mix(total)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as byte-plane deltas; unpack_sorted reverses it."""
    if not len(values):
        return b""
    delta = np.empty(len(values), np.uint64)
    delta[0] = values[0]
    np.subtract(values[1:], values[:-1], out=delta[1:])
    planes = delta.view(np.uint8).reshape(-1, 8).T
    head = bytes(int(plane[1:].any()) for plane in planes)
    return values[:1].tobytes() + head + b"".join(plane[1:].tobytes() for plane, keep in zip(planes, head, strict=True) if keep)


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    head = raw[8:16]
    kept = sum(head)
    n = (len(raw) - 16) // kept if kept else 0
    return _unpacked(raw, head, n)


def _unpacked(raw: bytes, head: bytes, n: int) -> np.ndarray:
    out = np.zeros((n + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8)
    at = 16
    for i, keep in enumerate(head):
        if keep:
            out[1:, i] = np.frombuffer(raw, np.uint8, n, at)
            at += n
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)
