"""Sequences at two bits a base for rows that travel, and comparison of their windows on Arrow batches.

A packed sequence is one byte that tells how many bases its last byte lacks, and four bases in every other byte.
One with letters other than ACGT keeps a byte for each.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RAW = 4
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, _RAW, np.uint8)
_CODE[_LETTERS] = np.arange(4)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[_LETTERS] = _LETTERS[::-1]
_FOUR = _LETTERS[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]
# Bases compared at a time.
_CHUNK = 1 << 22


def _flat(column: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of text or binary values."""
    column = column.cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.empty(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def pack(seqs: pa.Array) -> pa.Array:
    begins, letters = _flat(seqs, pa.large_string())
    lens = np.diff(begins)
    codes = _CODE[letters]
    others = np.concatenate([[0], np.cumsum(codes == _RAW)])[begins]
    raw = np.diff(others) > 0
    sizes = (lens + 3) // 4
    firsts = np.cumsum(sizes) - sizes
    padded = np.zeros(4 * int(sizes.sum()), np.uint8)
    padded[np.arange(len(codes)) + np.repeat(4 * firsts - begins[:-1], lens)] = codes & 3
    four = padded.reshape(-1, 4)
    body = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends[:-1]] = 4 * sizes - lens
    out[np.arange(len(body)) + np.repeat(np.arange(len(sizes)) + 1, sizes)] = body
    packed = pa.Array.from_buffers(
        pa.binary(), len(seqs), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    if not raw.any():
        return packed
    return pa.array([bytes([_RAW]) + letters[begins[i] : begins[i + 1]].tobytes() if raw[i] else x
                     for i, x in enumerate(packed.to_pylist())], pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all values, and where each one's begin and how many they are."""
    ends, data = _flat(column, pa.large_binary())
    head, at, size = data[ends[:-1]], ends[:-1] + 1, np.diff(ends) - 1
    letters = _FOUR[data].reshape(-1)
    raw = head == _RAW
    if not raw.any():
        return letters, 4 * at, 4 * size - head
    return np.concatenate([letters, data]), np.where(raw, len(letters) + at, 4 * at), np.where(raw, size, 4 * size - head)


def _strand(column: pa.Array, flip: pa.Array, first: np.ndarray, n: np.ndarray):
    """Letters ``first`` to ``first + n - 1`` of each value's strand, for a slice of the rows at a time."""
    letters, begin, size = _unpacked(column)
    back = flip.to_numpy(zero_copy_only=False)
    begin = begin + np.where(back, size - 1 - first, first)
    sign = np.where(back, -1, 1)

    def of(rows: slice, step: np.ndarray) -> np.ndarray:
        found = letters[np.repeat(begin[rows], n[rows]) + np.repeat(sign[rows], n[rows]) * step]
        return np.where(np.repeat(back[rows], n[rows]), _COMPLEMENT[found], found) if back[rows].any() else found
    return of


def windows_equal(a: pa.Array, a_flip: pa.Array, p: pa.Array, b: pa.Array, b_flip: pa.Array, n: pa.Array) -> pa.Array:
    n = np.maximum(n.to_numpy(zero_copy_only=False).astype(np.int64), 0)
    begin = p.to_numpy(zero_copy_only=False).astype(np.int64)
    one, two = _strand(a, a_flip, begin, n), _strand(b, b_flip, np.zeros(len(n), np.int64), n)
    before = np.concatenate([[0], np.cumsum(n)])
    same = np.empty(len(n), bool)
    cuts = np.unique(np.searchsorted(before, np.arange(0, before[-1] + _CHUNK, _CHUNK)).clip(0, len(n)))
    for low, high in zip(cuts, [*cuts[1:], len(n)]):
        rows = slice(low, high)
        at = before[low : high + 1] - before[low]
        step = np.arange(at[-1]) - np.repeat(at[:-1], n[rows])
        wrong = np.concatenate([[0], np.cumsum(one(rows, step) != two(rows, step))])[at]
        same[rows] = wrong[1:] == wrong[:-1]
    return pa.array(same)


def packed(seq):
    """Column of packed sequences."""
    return F.arrow_udf(pack, "binary")(seq)


def same_bases(a, a_flip, p, b, b_flip, n):
    """Whether ``n`` bases of strand a from ``p`` on are the first of strand b, of packed sequences."""
    return F.arrow_udf(windows_equal, "boolean")(a, a_flip, p, b, b_flip, n)
