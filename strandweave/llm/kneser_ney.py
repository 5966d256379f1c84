"""Interpolated modified Kneser-Ney language model, counted by Spark jobs.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end per text. Two
counting jobs shuffle packed, sorted arrays: tasks pre-aggregate what they read, a bucket
of the key range merges its share, and writes it as sorted arrays into the shared folder:

* vocabulary: sorted word hashes with their counts (a word's rank is its number);
* bigrams: sorted keys (number of the context, number of the word) with counts, and for each
  context its total and how many words follow it once, twice, and more often;
* continuations: in how many contexts each word occurs.

Workers memory-map these arrays and look up a chunk of tokens at a time in sorted order. The
probability of a word interpolates its discounted bigram estimate with the discounted
continuation estimate and that with a uniform share, which also covers unknown words. The
discounts come from the counts of counts of all training tokens.

Defined results: null and empty texts are a single end token. Without training texts every
token has probability 1. Repeated rows count and score as often as they occur.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import arrays
from strandweave.session import stage_path

END = np.uint64(1)
FLUSH = 4_000_000
LOOKUP_BYTES = 1 << 22
BUCKET_BYTES = 16 << 20
BASE_ADD = 0.1

_PACKED = "kind int, bucket int, payload binary"


def token_hashes(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row followed by the end token, and row bounds."""
    data = arrays.ASCII_LOWER[texts.data]
    starts, ends, bounds = texts.words(arrays.SOLID)
    words = texts.span_hash(texts.prefix_hash(data), starts, ends)
    words[words == END] += np.uint64(1)
    spread = np.arange(texts.rows + 1)
    out = np.full(len(words) + texts.rows, END, dtype=np.uint64)
    out[np.arange(len(words)) + arrays.row_of(bounds)] = words
    return out, bounds + spread


def pack(**columns: np.ndarray) -> bytes:
    """Columns as compressed bytes. A sorted first column is kept as differences; planes of equal
    significance are stored together, which compresses well."""
    out = io.BytesIO()
    for i, values in enumerate(columns.values()):
        if i == 0:
            values = np.diff(values, prepend=values.dtype.type(0))
        out.write(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())
    size = len(next(iter(columns.values())))
    return size.to_bytes(8, "little") + pa.compress(out.getvalue(), codec="zstd", asbytes=True)


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    width = sum(np.dtype(k).itemsize for k in kinds)
    raw = np.frombuffer(pa.decompress(payload[8:], decompressed_size=size * width, codec="zstd"), dtype=np.uint8)
    out, at = [], 0
    for i, kind in enumerate(kinds):
        wide = np.dtype(kind).itemsize
        plane = raw[at:at + size * wide].reshape(wide, size).T
        values = np.ascontiguousarray(plane).view(kind).reshape(-1)
        out.append(np.cumsum(values, dtype=kind) if i == 0 else values)
        at += size * wide
    return out


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Tallies:
    """Counts of 64-bit keys within one task, merged when many have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.size += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, dtype=np.uint64)])
        counts = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, dtype=np.int64)])
        found = tally(keys, counts)
        self.parts, self.size = [found], len(found[0])
        return found

    def full(self) -> bool:
        """Whether it should be emptied: it stays large after merging."""
        return self.size >= FLUSH and len(self.merged()[0]) >= FLUSH // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        found = self.merged()
        self.parts, self.size = [], 0
        return found


def _split(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray, kind: int) -> pa.RecordBatch:
    """Sorted counts as one packed row per bucket; ``edges`` are the first keys of buckets 1, 2, ..."""
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    used = np.flatnonzero(np.diff(cuts))
    rows = [pack(keys=keys[cuts[b]:cuts[b + 1]], counts=counts[cuts[b]:cuts[b + 1]].astype(np.uint64)) for b in used]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(used), kind), pa.int32()), pa.array(used, pa.int32()), pa.array(rows, pa.binary())],
        ["kind", "bucket", "payload"])


def _merged_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(kind, bucket, keys, counts)`` of each bucket, merging its packed rows as they come."""
    at: tuple[int, int] | None = None
    held = Tallies()
    for batch in batches:
        for kind, bucket, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if at is not None and (kind, bucket) != at:
                yield (*at, *held.take())
            at = (kind, bucket)
            keys, counts = unpack(payload, "<u8", "<u8")
            held.parts.append((keys, counts.astype(np.int64)))
            held.size += len(keys)
            if held.size >= FLUSH:
                held.merged()
    if at is not None:
        yield (*at, *held.take())


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a temporary name, then rename: a task run again replaces it by its equal."""
    store, path = _store(folder)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(np.ascontiguousarray(values))
    store.move(temporary, f"{path}/{name}")


@lru_cache(maxsize=100_000)
def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A stored array, memory-mapped; from a store without local paths, through a deleted local copy."""
    store, path = _store(folder)
    path = f"{path}/{name}"
    if not store.get_file_info(path).size:  # absent: no key fell into this bucket
        return np.zeros(0, dtype=kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(path) as f:
        while block := f.read(1 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=kind, mode="r")


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or eight where one needs them."""
    return counts.astype("<u8" if counts.size and int(counts.max()) >= 1 << 32 else "<u4")


def mapped_counts(folder: str, name: str, items: int) -> np.ndarray:
    """A stored ``narrow`` array of so many items."""
    raw = mapped(folder, name, "<u4")
    return raw if raw.size == items else raw.view("<u8")


@dataclass
class Vocabulary:
    """Folder with a sorted array of word hashes per bucket; ``starts`` are the first numbers."""

    folder: str
    starts: np.ndarray
    tokens: int

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    @property
    def buckets(self) -> int:
        return len(self.starts) - 1

    def edges(self) -> np.ndarray:
        return _hash_edges(self.buckets)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each hashed word."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        cuts = np.concatenate([[0], np.searchsorted(distinct, self.edges()), [len(distinct)]])
        for b in np.flatnonzero(np.diff(cuts)):
            known = mapped(self.folder, f"words-{b}", "<u8")
            if len(known) == 0:
                continue
            part = distinct[cuts[b]:cuts[b + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = np.flatnonzero(known[at] == part)
            number[cuts[b] + hit] = self.starts[b] + at[hit]
            count[cuts[b] + hit] = mapped_counts(self.folder, f"counts-{b}", len(known))[at[hit]]
        return number[back], count[back]


def _hash_edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)


def count_words(training: DataFrame, folder: str, buckets: int) -> Vocabulary:
    """Count all training tokens into the sorted hash arrays of a vocabulary."""
    edges = _hash_edges(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tallies()
        for batch in batches:
            for texts in arrays.chunks(batch.column(0)):
                held.add(token_hashes(texts)[0])
                if held.full():
                    yield _split(*held.take(), edges, 1)
        yield _split(*held.take(), edges, 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bucket, keys, counts in _merged_groups(batches):
            save(folder, f"words-{bucket}", keys.astype("<u8"))
            save(folder, f"counts-{bucket}", narrow(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())],
                ["bucket", "words", "tokens"])

    packed = training.select("text").mapInArrow(count, _PACKED)
    rows = (packed.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")
            .mapInArrow(merge, "bucket int, words long, tokens long").collect())  # a row per bucket
    sizes = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        sizes[r["bucket"]] = r["words"]
    return Vocabulary(folder, np.concatenate([[0], np.cumsum(sizes)]), sum(r["tokens"] for r in rows))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many entries have count 1, 2, 3, 4."""
    n = counts_of_counts.astype(float)
    y = n[0] / max(n[0] + 2 * n[1], 1.0)
    out = [0.0]
    for k in (1, 2, 3):
        value = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] > 0 else 0.5 * k
        out.append(float(min(max(value, 0.0), k)))
    return np.array(out)


@dataclass
class Model:
    """Vocabulary and the global figures of both orders; arrays are in the vocabulary's folder.

    ``edges`` cut the numbers of contexts (and of words) into the buckets of the bigram arrays.
    """

    words: Vocabulary
    edges: np.ndarray
    bigram_discounts: np.ndarray
    word_discounts: np.ndarray
    bigrams: int
    word_classes: np.ndarray


def _class_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


def count_bigrams(training: DataFrame, words: Vocabulary, buckets: int) -> Model:
    """Count bigrams by context and continuations by word; see the module for the arrays."""
    if words.size >= 1 << 32:
        raise ValueError("a vocabulary of 2^32 words or more does not fit the bigram keys")
    folder, start = words.folder, words.size  # the number past the last is the start of a text
    edges = np.array([(start + 1) * b // buckets for b in range(1, buckets)], dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tallies()
        for batch in batches:
            for texts in arrays.chunks(batch.column(0), LOOKUP_BYTES):
                hashes, bounds = token_hashes(texts)
                number = words.numbers(hashes)[0].astype(np.uint64)
                context = np.empty_like(number)
                context[1:] = number[:-1]
                context[bounds[:-1]] = start
                held.add((context << np.uint64(32)) | number)
                if held.full():
                    yield _split(*held.take(), edges << np.uint64(32), 2)
        yield _split(*held.take(), edges << np.uint64(32), 2)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.concatenate([[0], edges, [start + 1]]).astype(np.int64)
        for _, bucket, keys, counts in _merged_groups(batches):
            low, high = lows[bucket], lows[bucket + 1]
            context = (keys >> np.uint64(32)).astype(np.int64) - low
            save(folder, f"bigrams-{bucket}", keys.astype("<u8"))
            save(folder, f"times-{bucket}", narrow(counts))
            size = int(high - low)
            table = np.zeros((size, 4), dtype=np.int64)
            table[:, 0] = np.bincount(context, weights=counts, minlength=size)
            for k in (1, 2):
                table[:, k] = np.bincount(context[counts == k], minlength=size)
            table[:, 3] = np.bincount(context[counts >= 3], minlength=size)
            save(folder, f"contexts-{bucket}", narrow(table))
            yield _split(*tally(keys & np.uint64(0xFFFFFFFF)), edges, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array([4], pa.int32()), pa.array([bucket], pa.int32()),
                 pa.array([np.array([*_class_counts(counts), len(keys)], dtype="<i8").tobytes()], pa.binary())],
                ["kind", "bucket", "payload"])

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.concatenate([[0], edges, [start + 1]]).astype(np.int64)

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column(0).to_numpy()
                figures.extend(batch.filter(pa.array(kinds == 4)).column(2).to_pylist())
                yield batch.filter(pa.array(kinds == 3))

        figures: list[bytes] = []
        for _, bucket, keys, counts in _merged_groups(packed()):
            spread = np.zeros(int(lows[bucket + 1] - lows[bucket]), dtype=np.int64)
            spread[keys.astype(np.int64) - lows[bucket]] = counts
            save(folder, f"continuations-{bucket}", narrow(spread))
            found = np.array([*_class_counts(counts), len(keys)], dtype="<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([found], pa.binary())], ["kind", "figures"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([4] * len(figures), pa.int32()), pa.array(figures, pa.binary())], ["kind", "figures"])

    packed = training.select("text").mapInArrow(count, _PACKED)
    merged = packed.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(merge, _PACKED)
    rows = (merged.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")
            .mapInArrow(continuations, "kind int, figures binary").collect())  # two rows per bucket
    total = {k: sum((np.frombuffer(r["figures"], dtype="<i8") for r in rows if r["kind"] == k), np.zeros(6, dtype=np.int64))
             for k in (3, 4)}
    return Model(words, edges, discounts(total[4][:4]), discounts(total[3][:4]), int(total[4][5]),
                 np.array([total[3][0], total[3][1], total[3][4]]))


def _gather(model: Model, name: str, width: int, numbers: np.ndarray) -> np.ndarray:
    """Rows of a bucketed dense array at sorted ``numbers``."""
    out = np.zeros((len(numbers), width), dtype=np.int64)
    lows = np.concatenate([[0], model.edges, [model.words.size + 1]]).astype(np.int64)
    cuts = np.searchsorted(numbers, lows)
    for b in np.flatnonzero(np.diff(cuts)):
        table = mapped_counts(model.words.folder, f"{name}-{b}", int(lows[b + 1] - lows[b]) * width).reshape(-1, width)
        if len(table) == 0:
            continue
        out[cuts[b]:cuts[b + 1]] = table[numbers[cuts[b]:cuts[b + 1]] - lows[b]]
    return out


def bigram_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted bigram keys, 0 if absent."""
    out = np.zeros(len(keys), dtype=np.int64)
    cuts = np.concatenate([[0], np.searchsorted(keys, model.edges << np.uint64(32)), [len(keys)]])
    for b in np.flatnonzero(np.diff(cuts)):
        known = mapped(model.words.folder, f"bigrams-{b}", "<u8")
        if len(known) == 0:
            continue
        part = keys[cuts[b]:cuts[b + 1]]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        hit = np.flatnonzero(known[at] == part)
        out[cuts[b] + hit] = mapped_counts(model.words.folder, f"times-{b}", len(known))[at[hit]]
    return out


def word_probability(model: Model, numbers: np.ndarray) -> np.ndarray:
    """Interpolated continuation probability of sorted word numbers (-1: unknown)."""
    known = np.flatnonzero(numbers >= 0)
    times = np.zeros(len(numbers), dtype=np.int64)
    times[known] = _gather(model, "continuations", 1, numbers[known])[:, 0]
    d = model.word_discounts
    total = max(model.bigrams, 1)
    spared = float(d[1:] @ model.word_classes)
    return np.maximum(times - d[np.minimum(times, 3)], 0) / total + spared / total / (model.words.size + 1)


def token_logs(model: Model, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each token given the one before it."""
    if model.words.size == 0:
        return np.zeros(len(numbers))
    distinct, back = np.unique(numbers, return_inverse=True)
    lower = word_probability(model, distinct)[back]
    context = np.empty_like(numbers)
    context[1:] = numbers[:-1]
    context[bounds[:-1]] = model.words.size
    distinct, back = np.unique(context, return_inverse=True)
    seen = np.zeros((len(distinct), 4), dtype=np.int64)
    seen[distinct >= 0] = _gather(model, "contexts", 4, distinct[distinct >= 0])
    d = model.bigram_discounts
    spared = seen[:, 1:] @ d[1:]
    total, spared = seen[:, 0][back], spared[back]
    times = np.zeros(len(numbers), dtype=np.int64)
    both = np.flatnonzero((numbers >= 0) & (context >= 0))
    keys, place = np.unique((context[both].astype(np.uint64) << np.uint64(32)) | numbers[both].astype(np.uint64), return_inverse=True)
    times[both] = bigram_counts(model, keys)[place]
    some = np.maximum(total, 1)
    p = np.where(total > 0, np.maximum(times - d[np.minimum(times, 3)], 0) / some + spared / some * lower, lower)
    return np.log10(p)


def train(training: DataFrame) -> Model:
    """Count ``training(text)``, every row; arrays go to a fresh folder of the shared folder."""
    spark = training.sparkSession
    size = training.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    folder = stage_path(spark, "kneser-ney")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return count_bigrams(training, count_words(training, folder, buckets), buckets)


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: tokens, known ones, add-0.1 unigram and model log10 probability."""
    bottom = np.log10(model.words.tokens + BASE_ADD * (model.words.size + 1)) if model.words.size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0)] for _ in range(4)]
            for texts in arrays.chunks(batch.column(1), LOOKUP_BYTES):
                hashes, bounds = token_hashes(texts)
                number, count = model.words.numbers(hashes)
                base = np.log10(count + BASE_ADD) - bottom if model.words.size else np.zeros(len(count))
                for part, values in zip(out, (np.diff(bounds), arrays.row_sums((number >= 0).astype(np.int64), bounds),
                                              np.add.reduceat(base, bounds[:-1]),
                                              np.add.reduceat(token_logs(model, number, bounds), bounds[:-1])), strict=True):
                    part.append(values)
            n, known, base, logs = (np.concatenate(p) for p in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
