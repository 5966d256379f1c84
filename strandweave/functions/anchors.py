"""Anchor k-mers of sliding windows, computed on Arrow batches.

Higher-order SQL functions would evaluate the sliding minimum one interpreted lambda
call per base; here a batch is one flat byte array and every step is one numpy pass.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHOR_TYPE = "array<struct<hash: bigint, pos: int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _kmer_hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k letters starting at each index, built from hashes of half length."""
    whole, whole_len = None, 0
    part, part_len = letters.astype(np.uint64), 1
    part_pow = _BASE
    rest = k
    while True:
        if rest & 1:
            if whole is None:
                whole = part
            else:
                whole = whole[: len(part) - whole_len] * part_pow + part[whole_len:]
            whole_len += part_len
        rest >>= 1
        if not rest:
            break
        part = part[:-part_len] * part_pow + part[part_len:]
        part_pow = part_pow * part_pow
        part_len *= 2
    mixed = whole ^ (whole >> np.uint64(31))
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _running_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Leftmost index of the minimum of each run of w values."""
    at = np.arange(len(values))
    span = 1
    while span < w:
        step = min(span, w - span)
        first = values[:-step] <= values[step:]
        at = np.where(first, at[:-step], at[step:])
        values = np.where(first, values[:-step], values[step:])
        span += step
    return at


def batch_anchors(seqs: pa.Array, w: int, k: int, distinct: bool = True) -> pa.Array:
    """Per sequence the anchors ``(hash, pos)`` of its windows of w k-mers.

    ``distinct`` lists an anchor once for all neighbouring windows that share it.
    """
    seqs = seqs.cast(pa.large_string())
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[
        seqs.offset : seqs.offset + len(seqs) + 1
    ]
    buffer = seqs.buffers()[2]
    text = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    letters = text[offsets[0] : offsets[-1]]
    begins = offsets[:-1] - offsets[0]
    windows = np.maximum(np.diff(offsets) - (w + k - 2), 0)
    owner = np.repeat(np.arange(len(seqs)), windows)
    firsts = np.cumsum(windows) - windows
    start = begins[owner] + np.arange(len(owner)) - firsts[owner]
    if len(owner):
        with np.errstate(over="ignore"):
            hashes = _kmer_hashes(letters, k)
        if len(owner) == len(seqs) and len(letters) == len(seqs) * (w + k - 1):
            # One window each: no sliding minimum is needed.
            at = hashes[begins[:, None] + np.arange(w)].argmin(axis=1) + begins
        else:
            at = _running_argmin(hashes, w)[start]
    else:
        hashes, at = np.empty(0, np.uint64), start
    if distinct and len(at):
        keep = np.ones(len(at), dtype=bool)
        keep[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        at, owner = at[keep], owner[keep]
    counts = np.bincount(owner, minlength=len(seqs))
    anchors = pa.StructArray.from_arrays(
        [
            pa.array(hashes[at].view(np.int64)),
            pa.array((at - begins[owner]).astype(np.int32)),
        ],
        names=["hash", "pos"],
    )
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), anchors
    )


def window_anchors(w: int, k: int, distinct: bool = True):
    """Column function ``seq -> array<struct<hash, pos>>``; empty below ``w + k - 1`` bases."""

    def anchors(seqs: pa.Array) -> pa.Array:
        return batch_anchors(seqs, w, k, distinct)

    return F.arrow_udf(anchors, ANCHOR_TYPE)
