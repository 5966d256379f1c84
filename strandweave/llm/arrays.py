"""Numpy helpers on Arrow string columns: words, hashes and windows without per-row Python.

A chunk is a run of rows of at most about ``CHUNK_BYTES`` of text (one row if that row is
longer), so temporaries stay small whatever the batch size. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15
BASE = np.uint64(0x9E3779B97F4A7C15)
CLASS = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes of a word: digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of a word bounded by white space only.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; grown by doubling, shared by calls."""
    room = max(CHUNK_BYTES * 2, 1 << int(size).bit_length())
    forth, back = _powers(room)
    return forth[:size], back[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection), so that any bit range can be used."""
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


class Texts:
    """Bytes and row bounds of one chunk of a string column."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first
        self.rows = len(bounds) - 1

    def prefix_hash(self, data: np.ndarray) -> np.ndarray:
        """Running polynomial hash, one longer than ``data``; see ``span_hash``."""
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=total[1:])
        return total

    @staticmethod
    def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of bytes ``starts..ends``, the same wherever the span lies."""
        back = powers(len(total))[1]
        return mix((total[ends] - total[starts]) * back[starts])

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of maximal runs of ``inside`` bytes, and row bounds in words."""
        mask = inside[self.data]
        before = np.empty_like(mask)
        before[:1] = False
        before[1:] = mask[:-1]
        edges = self.bounds[:-1][self.bounds[:-1] < len(mask)]
        before[edges] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty_like(mask)
        after[-1:] = False
        after[:-1] = mask[1:]
        ends = self.bounds[1:]
        after[ends[ends > 0] - 1] = False
        stops = np.flatnonzero(mask & ~after) + 1
        return starts, stops, np.searchsorted(starts, self.bounds)


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into chunks of whole rows, at most ``CHUNK_ROWS`` of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + CHUNK_ROWS, len(column))
        yield Texts(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], first)
        first = last


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every element, given row bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row; empty rows give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.float64)
                     if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingle_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, by its first word."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    count = len(words) - size + 1
    out = words[:count].copy()
    for j in range(1, size):
        out = out * CLASS + words[j:j + count]
    return mix(out)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters, by Python's own rule."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and row bounds in code points."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[texts.bounds]
