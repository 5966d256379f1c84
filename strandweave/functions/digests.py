"""Digests of read windows in constant time each, from prefix hashes modulo a prime.

Sums of letters times powers of a base, kept along a batch of reads, give the hash of any window by one
subtraction and one product, wherever the window lies. All of it is numpy on Arrow batches.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strandweave.functions.anchors import batch_anchors

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
_P = np.uint64(PRIME)
_LOW31, _LOW30, _LOW32 = (np.uint64((1 << k) - 1) for k in (31, 30, 32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves."""
    au, ad = a >> np.uint64(31), a & _LOW31
    bu, bd = b >> np.uint64(31), b & _LOW31
    mid = ad * bu + au * bd
    high = _reduced(au * bu * np.uint64(2) + (mid >> np.uint64(30)))
    return _reduced(high + _reduced(((mid & _LOW30) << np.uint64(31)) + ad * bd))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(max(size, 1), dtype=np.uint64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done:done + more] = times(out[:more], np.uint64(pow(base, done, PRIME)))
        done += more
    return out


class Digests:
    """Prefix hashes of one Arrow batch of sequences."""

    def __init__(self, seqs: pa.Array):
        seqs = seqs.cast(pa.large_string())
        offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset:seqs.offset + len(seqs) + 1]
        buffer = seqs.buffers()[2]
        text = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
        letters = text[offsets[0]:offsets[-1]].astype(np.uint64)
        self.begins = offsets[:-1] - offsets[0]
        self.lens = np.diff(offsets)
        top = int(self.lens.max()) if len(self.lens) else 0
        self.back = _powers(pow(BASE, -1, PRIME), top + 1)
        place = np.arange(len(letters)) - np.repeat(self.begins, self.lens)
        terms = times(letters, _powers(BASE, top + 1)[place])
        # Sums of 61-bit terms, in halves that cannot overflow.
        low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> np.uint64(32))
        self.sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        self.sums[1:] = _reduced(_reduced(low) + times(_reduced(high), np.uint64(1 << 32)))

    def of(self, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of ``length`` letters from ``start`` of sequence ``owner``."""
        begin = self.begins[owner] + start
        span = self.sums[begin + length] + _P - self.sums[begin]
        return times(_reduced(span), self.back[start]).view(np.int64)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every element of lists of ``counts`` elements."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def batch_prefixes(seqs: pa.Array) -> pa.Array:
    """Per sequence the hashes of its first 1, 2, ... letters."""
    known = Digests(seqs)
    owner, place = _runs(known.lens)
    return _lists(pa.array(known.of(owner, np.zeros_like(place), place + 1)), known.lens)


def batch_suffixes(seqs: pa.Array, w: int, k: int) -> pa.Array:
    """Per sequence and window of w k-mers: the window's anchor, and the hash of all letters from its start on."""
    known = Digests(seqs)
    anchors = batch_anchors(seqs, w, k, distinct=False)
    counts = np.diff(anchors.offsets.to_numpy())
    owner, place = _runs(counts)
    rest = pa.array(known.of(owner, place, known.lens[owner] - place))
    return _lists(pa.StructArray.from_arrays([anchors.values.field("hash"), rest], names=["anchor", "digest"]), counts)


def batch_spans(seqs: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    """Per sequence the hashes of the listed spans."""
    known = Digests(seqs)
    counts = np.diff(starts.offsets.to_numpy())
    owner, _ = _runs(counts)
    first, last = int(starts.offsets[0].as_py()), int(starts.offsets[-1].as_py())
    begin = starts.values.slice(first, last - first).to_numpy().astype(np.int64)
    first, last = int(lengths.offsets[0].as_py()), int(lengths.offsets[-1].as_py())
    size = lengths.values.slice(first, last - first).to_numpy().astype(np.int64)
    return _lists(pa.array(known.of(owner, begin, size)), counts)


def prefix_digests():
    """Column function ``seq -> array<bigint>``."""
    return F.arrow_udf(lambda seqs: batch_prefixes(seqs), "array<bigint>")


def suffix_digests(w: int, k: int):
    """Column function ``seq -> array<struct<anchor, digest>>``, one per window."""
    return F.arrow_udf(lambda seqs: batch_suffixes(seqs, w, k), "array<struct<anchor: bigint, digest: bigint>>")


def span_digests():
    """Column function ``(seq, starts, lengths) -> array<bigint>``."""
    return F.arrow_udf(lambda seqs, starts, lengths: batch_spans(seqs, starts, lengths), "array<bigint>")
