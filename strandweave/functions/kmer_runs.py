"""Counting k-mers by way of runs: neighbouring k-mers of a read that share their least m-mer travel as one piece of text.

The least m-mer (by hash, either strand) is the same for a k-mer and its reverse complement, so all occurrences of a
k-mer meet at one key, and a read of n k-mers sends about ``2 n / (k - m)`` rows at two bits a base. All of it is numpy on Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from strandweave.functions.anchors import _running_argmin
from strandweave.functions.packing import _CODE, _LETTERS, _flat, _unpacked, pack

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINIMIZER = 15
# Coarse counts by which keys with very many runs are told.
BUCKETS = 1 << 16
# Bases that a task counts at a time; the runs of one key are never divided.
CHUNK_BASES = 1 << 22

RUN_TYPE = "key bigint, bases binary, n bigint, reads bigint"
COUNT_TYPE = "kmer string, occurrences bigint, reads bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one hash of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _packed_words(codes: np.ndarray, k: int) -> np.ndarray:
    """The ``k <= 32`` codes from each index on as one number, built from those of half length."""
    whole, whole_len = None, 0
    part, part_len, rest = codes.astype(np.uint64), 1, k
    while True:
        if rest & 1:
            whole = part if whole is None else (whole[: len(part) - whole_len] << np.uint64(2 * part_len)) | part[whole_len:]
            whole_len += part_len
        rest >>= 1
        if not rest:
            return whole[: len(codes) - k + 1]
        part = (part[:-part_len] << np.uint64(2 * part_len)) | part[part_len:]
        part_len *= 2


def _kmer_words(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The k-mer from each index on, in numbers of up to 32 bases."""
    size = max(len(codes) - k + 1, 0)
    return [_packed_words(codes[at:], min(32, k - at))[:size] if size else np.empty(0, np.uint64) for at in range(0, k, 32)]


def _canonical(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The lesser of the k-mer from each index on and its reverse complement."""
    one, two = _kmer_words(codes, k), [x[::-1] for x in _kmer_words(3 - codes[::-1], k)]
    less, same = np.zeros(len(one[0]), bool), np.ones(len(one[0]), bool)
    for x, y in zip(one, two):
        less |= same & (x < y)
        same &= x == y
    return [np.where(less, x, y) for x, y in zip(one, two)]


def _places(sizes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of every k-mer of texts that begin at ``begins``."""
    counts = np.maximum(sizes - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    return owner, begins[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _totals(words: list[np.ndarray], n: np.ndarray, reads: np.ndarray, *more: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``words`` and ``more`` and their sums of ``n`` and ``reads``."""
    names = [f"w{i}" for i in range(len(words) + len(more))]
    table = pa.table([*words, *more, n, reads], names=[*names, "n", "reads"])
    found = table.group_by(names, use_threads=False).aggregate([("n", "sum"), ("reads", "sum")])
    columns = [found[c].to_numpy() for c in (*names, "n_sum", "reads_sum")]
    return columns[:-2], columns[-2:]


def _letters(words: list[np.ndarray], k: int) -> pa.Array:
    """Texts of k-mers."""
    out = np.empty((len(words[0]), k), np.uint8)
    for i in range(k):
        last = min(32, k - i // 32 * 32) - 1
        out[:, i] = _LETTERS[((words[i // 32] >> np.uint64(2 * (last - i % 32))) & np.uint64(3)).astype(np.intp)]
    offsets = np.arange(len(out) + 1, dtype=np.int64) * k
    return pa.Array.from_buffers(pa.large_string(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


class _Batch:
    """Texts over ACGT of one batch, cut into runs."""

    def __init__(self, seqs: pa.Array, k: int):
        self.k = k
        begins, self.text = _flat(seqs.drop_null() if seqs.null_count else seqs, pa.large_string())
        self.begins, self.sizes = begins[:-1], np.diff(begins)
        self.codes = _CODE[self.text]
        m = min(k, MINIMIZER)
        self.owner, self.at = _places(self.sizes, self.begins, k)
        if not len(self.owner):
            self.keys, self.tied, self.first = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
            return
        with np.errstate(over="ignore"):
            hashes = _mixed(_canonical(self.codes, m)[0])
        w = k - m + 1
        low = _running_argmin(hashes, w)
        high = len(hashes) - 1 - _running_argmin(hashes[::-1], w)[::-1]
        least = low[self.at]
        self.keys, self.tied = hashes[least].view(np.int64), least != high[self.at]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.first = np.flatnonzero(new)

    def run_keys(self) -> np.ndarray:
        return self.keys[self.first]

    def rows(self, weight: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """Rows of ``RUN_TYPE``: runs, and single k-mers where a read may hold one twice or the key is crowded."""
        if not len(self.owner):
            return
        keys, owner = self.run_keys(), self.owner[self.first]
        # Within a read a k-mer comes again only under the same least m-mer: in another run, or where that ties.
        order = np.lexsort((keys, owner))
        again = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        doubtful = np.zeros(len(self.sizes), bool)
        doubtful[owner[order][1:][again]] = True
        doubtful[self.owner[self.tied]] = True
        crowded = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
        plain = ~doubtful[owner] & ~crowded
        ends = np.append(self.first[1:], len(self.owner))
        sizes = (ends - self.first + self.k - 1)[plain]
        yield keys[plain], self._texts(self.at[self.first][plain], sizes), weight[owner[plain]], np.ones(len(sizes), np.int64)
        single = np.repeat(~plain, ends - self.first)
        if not single.any():
            return
        place, of = self.at[single], self.owner[single]
        words = [x[place] for x in _canonical(self.codes, self.k)]
        spread = np.repeat(crowded, ends - self.first)[single]
        with np.errstate(over="ignore"):
            own = words[0]
            for x in words[1:]:
                own = _mixed(own) + x
        key = np.where(spread, _mixed(own).view(np.int64), self.keys[single])
        # Once a read, then once for all reads of the batch.
        found, (n, _) = _totals(words, weight[of], np.zeros(len(of), np.int64), key, of)
        found, (n, reads) = _totals(found[:-2], n, np.ones(len(n), np.int64), found[-2])
        yield found[-1], pack(_letters(found[:-1], self.k)), n, reads

    def _texts(self, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pack(pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.text[at])]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about ``CHUNK_BASES`` letters each."""
    for b in batches:
        begins, _ = _flat(b.column("seq"), pa.large_string())
        cuts = np.unique(np.searchsorted(begins, np.arange(0, begins[-1] + CHUNK_BASES, CHUNK_BASES)).clip(0, b.num_rows))
        for low, high in zip(cuts, cuts[1:]):
            yield b.slice(low, high - low)


def crowd(k: int):
    """Function on batches ``(seq, n)``: ``(bucket, runs)``, the runs of every bucket of keys."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in _slices(batches):
            total += np.bincount(_Batch(b.column("seq"), k).run_keys() & (BUCKETS - 1), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "runs"])
    return counted


def crowded_keys(k: int, buckets: list[int]):
    """Function on batches ``(seq, n)``: ``(key, runs)`` of the keys in ``buckets``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keys = _Batch(b.column("seq"), k).run_keys()
            keys, runs = np.unique(keys[np.isin(keys & (BUCKETS - 1), buckets)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(runs)], names=["key", "runs"])
    return counted


def runs(k: int, hot: list[int]):
    """Function on batches ``(seq, n)``, texts over ACGT and how often each counts: rows of ``RUN_TYPE``."""
    crowded = np.array(sorted(hot), np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            weight = b.column("n").to_numpy()
            if b.column("seq").null_count:
                weight = weight[b.column("seq").is_valid().to_numpy(zero_copy_only=False)]
            for columns in _Batch(b.column("seq"), k).rows(weight, crowded):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "bases", "n", "reads"])
    return cut


def _counted(table: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    letters, begins, sizes = _unpacked(table["bases"].combine_chunks())
    owner, at = _places(sizes, begins, k)
    words = [x[at] for x in _canonical(_CODE[letters], k)]
    n, reads = (table[c].to_numpy()[owner] for c in ("n", "reads"))
    words, sums = _totals(words, n, reads)
    for low in range(0, len(words[0]), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [_letters([x[part] for x in words], k).cast(pa.string()), *[pa.array(s[part]) for s in sums]], names=["kmer", "occurrences", "reads"])


def counts(k: int, chunk_bases: int = CHUNK_BASES):
    """Function on batches of ``RUN_TYPE`` that hold all runs of a key, sorted by it: rows of ``COUNT_TYPE``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += 4 * b.column("bases").nbytes
            if size < chunk_bases:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield from _counted(table.slice(0, whole), k)
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), 4 * rest["bases"].nbytes
        if held:
            yield from _counted(pa.Table.from_batches(held), k)
    return counted
