"""Benchmark decontamination as a prefix-filtered containment join.

A window is ``window`` consecutive words of a benchmark item (all of a shorter item). It
is compared as a sequence of word shingles of ``SHINGLE`` words, ordered by rarity: their
frequency counted over all documents. For full containment one prefix token, the rarest
shingle of the window, is necessary; documents are joined on it. Candidates must start at
or after the first word of the document (positional bound) and end within it (length bound),
and are then verified shingle by shingle over the whole window.

Windows are joined in blocks of at most ``BLOCK`` windows, and a block's findings are written before the next but
one is fetched, so what a task or the driver holds is bounded;
the blocks are a stated query set run against all documents.

Defined results: null or empty texts have no words and are clean; items without words have no
windows; rows of an item id that occurs several times count as one item; a null item id is
named by the empty string. Repeated documents give one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import arrays
from strandweave.session import write_stage

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000

_HIT = "row long, doc_id long, n_words long, spans array<int>, items array<string>"


@dataclass
class WindowBlock:
    """Windows of one block. A window has ``sizes`` words in shingles of ``grams`` words,
    hashed in ``hashes`` (padded); ``prefix`` is its join token, ``shift`` its place."""

    prefix: np.ndarray
    shift: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray
    hashes: np.ndarray
    items: np.ndarray


def word_hashes(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk and row bounds in words."""
    data = arrays.ASCII_LOWER[texts.data]
    starts, ends, bounds = texts.words(arrays.ALNUM)
    return texts.span_hash(texts.prefix_hash(data), starts, ends), bounds


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One row per window: item, number of words, shingle size, shingle hashes."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        out: list[tuple[str, int, int, list[int]]] = []
        for texts in arrays.chunks(batch.column(1)):
            words, bounds = word_hashes(texts)
            for i in range(texts.rows):
                own = words[bounds[i]:bounds[i + 1]]
                if len(own) == 0:
                    continue
                size = min(window, len(own))
                gram = min(SHINGLE, size)
                shingles = arrays.shingle_hash(own, gram).view(np.int64)
                for j in range(len(own) - size + 1):
                    out.append((names[texts.first + i], size, gram, shingles[j:j + size - gram + 1].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
            ["item", "size", "gram", "hashes"])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``benchmark(item_id, text)`` with the item they come from."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(lambda b: _windows(b, window), "item string, size int, gram int, hashes array<long>").distinct()


def _counter(vocabulary: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {g: np.zeros(len(v), dtype=np.int64) for g, v in vocabulary.items()}
        for batch in batches:
            for texts in arrays.chunks(batch.column(0)):
                words, _ = word_hashes(texts)
                for g, known in vocabulary.items():
                    hashes = arrays.shingle_hash(words, g)
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    seen[g] += np.bincount(at[known[at] == hashes], minlength=len(known))
        for g, known in vocabulary.items():
            found = np.flatnonzero(seen[g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), g), pa.int32()), pa.array(known[found].view(np.int64), pa.int64()),
                 pa.array(seen[g][found], pa.int64())], ["gram", "hash", "n"])
    return run


def window_blocks(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> Iterator[WindowBlock]:
    """Windows in blocks of at most ``block``, each with its rarest shingle by frequency in ``docs``."""
    total = windows.count()
    parts = max(1, -(-total // block))
    for k in range(parts if total else 0):
        part = windows.where(F.pmod(F.xxhash64("hashes"), F.lit(parts)) == k) if parts > 1 else windows
        rows = part.orderBy("item", "hashes").collect()  # about ``block`` rows, the bound of this module
        if not rows:
            continue
        grams = np.array([r["gram"] for r in rows])
        sizes = np.array([r["size"] for r in rows])
        hashes = np.zeros((len(rows), max(len(r["hashes"]) for r in rows)), dtype=np.uint64)
        for i, r in enumerate(rows):
            hashes[i, :len(r["hashes"])] = np.array(r["hashes"], dtype=np.int64).view(np.uint64)
        used = np.arange(hashes.shape[1]) < (sizes - grams + 1)[:, None]
        vocabulary = {int(g): np.unique(hashes[grams == g][used[grams == g]]) for g in np.unique(grams)}
        counts = (docs.select("text").mapInArrow(_counter(vocabulary), "gram int, hash long, n long")
                  .groupBy("gram", "hash").agg(F.sum("n").alias("n")))
        seen = {g: np.zeros(len(v), dtype=np.int64) for g, v in vocabulary.items()}
        for r in counts.toLocalIterator():  # at most one row per shingle of the block
            g = r["gram"]
            seen[g][np.searchsorted(vocabulary[g], np.array([r["hash"]], dtype=np.int64).view(np.uint64)[0])] = r["n"]
        rarity = np.full(hashes.shape, np.iinfo(np.int64).max)
        for g, known in vocabulary.items():
            mine = (grams == g)[:, None] & used
            rarity[mine] = seen[g][np.searchsorted(known, hashes[mine])]
        shift = rarity.argmin(axis=1)
        prefix = hashes[np.arange(len(rows)), shift]
        order = np.argsort(prefix, kind="stable")
        yield WindowBlock(prefix[order], shift[order], sizes[order], grams[order], hashes[order],
                          np.array([r["item"] for r in rows], dtype=object)[order])


def find_windows(words: np.ndarray, bounds: np.ndarray, block: WindowBlock) -> tuple[np.ndarray, np.ndarray]:
    """``(start word, window)`` of every occurrence of the block's windows in rows of words."""
    found_at, found_window = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for g in np.unique(block.grams):
        shingles = arrays.shingle_hash(words, int(g))
        mine = np.flatnonzero(block.grams == g)
        keys = block.prefix[mine]
        low = np.searchsorted(keys, shingles, side="left")
        at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == shingles)
        if len(at) == 0:
            continue
        low = low[at]
        copies = np.searchsorted(keys, shingles[at], side="right") - low
        at = np.repeat(at, copies)
        within = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        window = mine[np.repeat(low, copies) + within]
        start = at - block.shift[window]
        row = np.searchsorted(bounds, at, side="right") - 1
        fits = (start >= bounds[row]) & (start + block.sizes[window] <= bounds[row + 1])
        start, window = start[fits], window[fits]
        for j in range(int((block.sizes[mine] - g + 1).max())):
            longer = block.sizes[window] - g + 1 > j
            same = ~longer
            same[longer] = shingles[start[longer] + j] == block.hashes[window[longer], j]
            start, window = start[same], window[same]
        found_at.append(start)
        found_window.append(window)
    return np.concatenate(found_at), np.concatenate(found_window)


def _matcher(block: WindowBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for texts in arrays.chunks(batch.column(2)):
                words, bounds = word_hashes(texts)
                start, window = find_windows(words, bounds, block)
                order = np.argsort(start, kind="stable")
                start, window = start[order], window[order]
                cuts = np.searchsorted(start, bounds)
                n_words += np.diff(bounds).tolist()
                for i in range(texts.rows):
                    s, w = start[cuts[i]:cuts[i + 1]] - bounds[i], window[cuts[i]:cuts[i + 1]]
                    spans.append(merged_spans(s, s + block.sizes[w]))
                    items.append(sorted(set(block.items[w])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])
    return run


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Flat list of disjoint word spans (start, end, start, end ...) that cover the given ones."""
    out: list[int] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _joined(spans: list[list[int]]) -> list[int]:
    pairs = sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2))
    return merged_spans(np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the blocks' findings of each document into its result row."""
    for batch in batches:
        spans = [_joined(s) for s in batch.column(2).to_pylist()]
        items = [sorted({x for part in i for x in part}) for i in batch.column(3).to_pylist()]
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
             pa.array([h > 0 for h in hits], pa.bool_()), pa.array(spans, pa.list_(pa.int32()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<int>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: words, words hit, items found, digest of the items, flag, hit word spans."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    empty = WindowBlock(*[np.zeros(0, dtype=np.uint64)] * 2, *[np.zeros(0, dtype=np.int64)] * 2,
                        np.zeros((0, 1), dtype=np.uint64), np.zeros(0, dtype=object))
    blocks = window_blocks(docs, benchmark_windows(benchmark, window), block)
    first, second = next(blocks, empty), next(blocks, None)
    found = rows.mapInArrow(_matcher(first), _HIT)
    if second is None:
        whole = found.select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:  # a block's findings are written before the next block is fetched; few parts of one row meet, whatever the data
        union = write_stage(found, "found")
        for more in chain([second], blocks):
            union = union.unionByName(write_stage(rows.mapInArrow(_matcher(more), _HIT).where("size(spans) > 0"), "found"))
        whole = union.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).drop("row")
    return whole.mapInArrow(_digest, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` without any benchmark window; columns and other rows unchanged."""
    blocks = window_blocks(docs, benchmark_windows(benchmark, window), block)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(_sieve(first, docs.columns.index("text"), True), docs.schema)
    keys = docs.select("doc_id", "text")
    hit = None  # ids and digests of the texts that a block is found in, written before the next block is fetched
    for found in chain([first, second], blocks):
        part = keys.mapInArrow(_sieve(found, 1, False), keys.schema).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).distinct()
        part = write_stage(part, "hit")
        hit = part if hit is None else hit.unionByName(part)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_hash"]), "left_anti")


def _sieve(block: WindowBlock, text_at: int, clean: bool):
    """Rows without (``clean``) or with a window of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.full(batch.num_rows, clean)
            for texts in arrays.chunks(batch.column(text_at)):
                words, bounds = word_hashes(texts)
                start, _ = find_windows(words, bounds, block)
                keep[texts.first + np.searchsorted(bounds, start, side="right") - 1] = not clean
            yield batch.filter(pa.array(keep))
    return run
