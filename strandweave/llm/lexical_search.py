"""Ranked lexical search over bit-sliced Bloom signatures of documents.

The index groups documents of similar size into blocks. A block is a matrix of bits: one column per
document, one row (*slice*) per position of a Bloom filter, stored slice by slice. A document
inserts the key (term, level) for every level up to the logarithm-like step of the term's frequency,
so that the AND of a key's slices is a bitmap of documents that overestimates where the
term occurs, and at least how often.

A search bounds every score from above: over the item's terms, the weight times the largest
term factor that the document's levels allow, added up over the bitmaps of a block. A few
documents of highest bound are scored exactly first; the score of the tenth of them is the threshold
of the item. Every document whose bound reaches it (the rest is provably lower) is then
scored exactly on its whole text, and the ten best remain.

Bounds only ever overestimate: false positives of the filters, and hash collisions of terms,
cost an exact score and change no result. Frequencies of terms over the collection and all scores are
counted on the terms themselves.

Items are taken in blocks of at most ``ITEM_BLOCK`` items and ``TERM_BLOCK`` terms (or a single larger
item), the bound of what is sent to tasks at once. Each task keeps the ten best of its rows, so
what is ranked at the end does not grow with the documents.

Defined results: null and empty texts have no terms and are never returned; items without terms have
no rows; rows of one item id count as one item with the terms of all of them, a null id too. Repeated
documents and rows of one doc_id are ranked each for itself; equal scores go by ascending doc_id, a
null doc_id first. An empty table gives no rows. Fewer than ten documents score above 0: all of
them are returned.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from strandweave.llm import arrays
from strandweave.session import write_stage

TOP = 10
SEEDS = 20
ITEM_BLOCK = 256
TERM_BLOCK = 1 << 14

#: Frequencies at which a key of the next level is inserted.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 1024)
BITS_PER_KEY = 8
HASHES = 3
LEAST_BITS = 256
BLOCK_BITS = 1 << 24
BLOCK_ROWS = 2048
_TERM_STEP = 512

# Fixed constants of the score.
SCALE, TF_SCALE, LENGTH_SCALE = 1_000_000_000, 1000, 8

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_BLOCK = "width int, rows int, ids array<long>, lens array<long>, tops array<long>, slices binary"
_FOUND = "item int, doc long, bound double"
_BEST = "item int, doc_id long, score long"
#: Stands for a null doc_id in joins; a row it meets by chance is only scored once more.
_NO_ID = -(1 << 63)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; ``bytes.lower`` changes A-Z only."""
    return TERM.findall(text.lower())


def _level_keys(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hash of (term, level) keys."""
    return arrays.mix(keys * arrays.CLASS + (level.astype(np.uint64) + np.uint64(1)) * arrays.BASE)


def _slots(keys: np.ndarray, width: int) -> np.ndarray:
    """The ``HASHES`` slices of each key in a filter of ``width`` (a power of two) bits."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((keys + k * step) & np.uint64(width - 1)).astype(np.int64)


def _chunk_keys(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk: keys of all rows, their row bounds, terms of each row, and its largest frequency."""
    data = arrays.ASCII_LOWER[texts.data]
    starts, ends, bounds = texts.words(arrays.ALNUM)
    words = texts.span_hash(texts.prefix_hash(data), starts, ends)
    rows = arrays.row_of(bounds)
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    head = np.ones(len(words), dtype=bool)
    head[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(head)
    freq = np.diff(np.append(at, len(words)))
    term, row = words[at], rows[at]
    depth = np.searchsorted(LEVELS, freq, side="right")
    keys = _level_keys(np.repeat(term, depth), np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))
    key_bounds = np.searchsorted(np.repeat(row, depth), np.arange(texts.rows + 1))
    tops = np.zeros(texts.rows, dtype=np.int64)
    np.maximum.at(tops, row, freq)
    return keys, key_bounds, np.diff(bounds), tops


class _Open:
    """Documents of one width waiting to fill a block."""

    def __init__(self, width: int):
        self.width, self.room = width, max(8, min(BLOCK_ROWS, BLOCK_BITS // width))
        self.ids: list = []
        self.lens: list[int] = []
        self.tops: list[int] = []
        self.keys: list[np.ndarray] = []

    def row(self) -> dict:
        rows = -(-len(self.ids) // 8) * 8
        bits = np.zeros(self.width * rows, dtype=bool)
        column = np.repeat(np.arange(len(self.ids)), [len(k) for k in self.keys])
        bits[(_slots(np.concatenate(self.keys), self.width) * rows + column).ravel()] = True
        return {"width": self.width, "rows": rows, "ids": self.ids, "lens": self.lens, "tops": self.tops,
                "slices": np.packbits(bits).tobytes()}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _Open] = {}
    kinds = {"width": pa.int32(), "rows": pa.int32(), "ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int64()),
             "tops": pa.list_(pa.int64()), "slices": pa.binary()}

    def batch_of(block: _Open) -> pa.RecordBatch:
        row = block.row()
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], list(kinds))

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for texts in arrays.chunks(batch.column(1)):
            keys, bounds, lens, tops = _chunk_keys(texts)
            for i in np.flatnonzero(lens):
                own = keys[bounds[i]:bounds[i + 1]]
                width = max(LEAST_BITS, 1 << int(len(own) * BITS_PER_KEY - 1).bit_length())
                block = open_blocks.setdefault(width, _Open(width))
                block.ids.append(ids[texts.first + i])
                block.lens.append(int(lens[i]))
                block.tops.append(int(tops[i]))
                block.keys.append(own.copy())
                if len(block.ids) == block.room:
                    yield batch_of(open_blocks.pop(width))
    for block in open_blocks.values():
        yield batch_of(block)


@dataclass(frozen=True)
class Index:
    """Written signature blocks of all documents with terms, and what scores need of the collection."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Index of ``(doc_id, text)``: one pass over whole texts, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = write_stage(rows.mapInArrow(_index, _BLOCK), "signatures")
    total = blocks.agg(
        F.sum(F.size("ids").cast("long")),
        F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Index(blocks, total[0] or 0, total[1] or 0)


@dataclass
class Queries:
    """One block of items: ``counts[i, t]`` repeats of term t in item i, and the weight of each term."""

    items: list
    terms: list[bytes]
    counts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def hashes(self) -> np.ndarray:
        """The index's hashes of the terms."""
        texts = next(iter(arrays.chunks(pa.array([b" ".join(self.terms).decode("utf-8")]), 1 << 40)))
        starts, ends, _ = texts.words(arrays.ALNUM)
        return texts.span_hash(texts.prefix_hash(texts.data), starts, ends)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, terms, counts = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term, n in Counter(terms_of((text or "").encode())).items():
                names.append(name)
                terms.append(term)
                counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "term", "n"])


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Items with their terms, a bounded number of items and terms at a time."""
    listed = (items.select(F.col("item_id").cast("long").alias("item_id"), "text")
              .mapInArrow(_item_terms, "item_id long, term binary, n long")
              .groupBy("item_id", "term").agg(F.sum("n").alias("n")).orderBy("item_id", "term"))
    held: list[tuple] = []
    names: list = []
    seen: set[bytes] = set()

    def block() -> Queries:
        terms = sorted({t for _, t, _ in held})
        place = {t: k for k, t in enumerate(terms)}
        counts = np.zeros((len(names), len(terms)), dtype=np.int64)
        for i, t, n in held:
            counts[i, place[t]] = n
        return Queries(list(names), terms, counts)

    last: object = held  # no item's id
    for row in listed.toLocalIterator():  # one block of items is held at a time
        if row["item_id"] != last or last is held:
            if len(names) >= ITEM_BLOCK or len(seen) >= TERM_BLOCK:
                yield block()
                held, names, seen = [], [], set()
            last = row["item_id"]
            names.append(last)
        term = bytes(row["term"])
        held.append((len(names) - 1, term, row["n"]))
        seen.add(term)
    if names:
        yield block()


def _term_counter(terms: list[bytes]):
    wanted = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(terms), dtype=np.int64)
        known = wanted.keys()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                if text.is_valid:
                    for term in known & set(terms_of(text.as_py())):
                        seen[wanted[term]] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["term", "n"])
    return run


def weigh(docs: DataFrame, index: Index, queries: Queries) -> Queries:
    """Weights of the terms from the number of documents that hold them: one pass, no shuffle of texts."""
    held = (docs.select("text").mapInArrow(_term_counter(queries.terms), "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # at most a row per term of the block
    df = np.zeros(len(queries.terms), dtype=np.int64)
    for row in held:
        df[row["term"]] = row["n"]
    n = index.documents
    queries.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    return queries


def _length_factor(lens: np.ndarray, index_documents: int, index_terms: int) -> np.ndarray:
    """The m of each document: its length against the mean, in hundredths."""
    return np.array([25 + 75 * int(n) * index_documents // index_terms for n in lens], dtype=np.int64)


def _level_factors(m: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Largest term factor per (number of levels set, document): the frequency stays below the next level."""
    out = np.zeros((len(LEVELS) + 1, len(m)), dtype=np.float64)
    for level in range(1, len(LEVELS) + 1):
        most = tops if level == len(LEVELS) else np.minimum(tops, LEVELS[level] - 1)
        tf = np.maximum(most, 0)
        out[level] = (SCALE * tf) // np.maximum(TF_SCALE * tf + LENGTH_SCALE * m, 1)
    return out


class _Bounds:
    """Upper bounds of all items over the documents of a block."""

    def __init__(self, queries: Queries, index: Index):
        self.documents, self.terms = index.documents, index.terms
        weight = (queries.counts * queries.weights).astype(np.float64)
        used = np.flatnonzero(weight.any(axis=0))
        self.weight = np.ascontiguousarray(weight[:, used])
        hashes = queries.hashes()[used]
        self.keys = [_level_keys(hashes, np.full(len(hashes), level)) for level in range(len(LEVELS))]

    def of(self, width: int, rows: int, lens: np.ndarray, tops: np.ndarray, slices: bytes) -> np.ndarray:
        """``(items, documents)``, a hair above the exact sum so that rounding never lowers a bound."""
        matrix = np.frombuffer(slices, dtype=np.uint8).reshape(width, rows // 8)
        real = len(lens)
        factors = _level_factors(_length_factor(lens, self.documents, self.terms), tops)
        column = np.arange(real)
        bound = np.zeros((len(self.weight), real))
        for first in range(0, self.weight.shape[1], _TERM_STEP):
            part = slice(first, first + _TERM_STEP)
            depth = None
            live = None
            for keys in self.keys:
                slots = _slots(keys[part], width)
                hit = matrix[slots[0]]
                for more in slots[1:]:
                    hit = hit & matrix[more]
                live = hit if live is None else live & hit
                if not live.any():
                    break
                flags = np.unpackbits(live, axis=1)[:, :real]
                depth = flags if depth is None else depth + flags
            if depth is not None:
                bound += self.weight[:, part] @ factors[depth, column]
        return bound * (1 + 1e-9)


def _blocks_of(batches: Iterator[pa.RecordBatch], bounds: _Bounds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = np.array([_NO_ID if x is None else x for x in batch.column(2)[k].as_py()], dtype=np.int64)
            lens, tops = (np.array(batch.column(c)[k].as_py(), dtype=np.int64) for c in (3, 4))
            yield ids, bounds.of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), lens, tops, batch.column(5)[k].as_py())


def _found_batch(items: np.ndarray, docs: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(items, pa.int32()), pa.array(docs, pa.int64()), pa.array(bound, pa.float64())], ["item", "doc", "bound"])


def _seeds(queries: Queries, index: Index):
    """The documents of highest bound of each item, per task."""
    size = (index.documents, index.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(queries, Index(None, *size))
        best_docs = [np.zeros(0, dtype=np.int64)] * len(queries.items)
        best = [np.zeros(0)] * len(queries.items)
        for ids, bound in _blocks_of(batches, bounds):
            for i in range(len(best)):
                both, docs = np.append(best[i], bound[i]), np.append(best_docs[i], ids)
                if len(both) > SEEDS:
                    keep = np.argpartition(-both, SEEDS - 1)[:SEEDS]
                    both, docs = both[keep], docs[keep]
                best[i], best_docs[i] = both, docs
        items = np.repeat(np.arange(len(best)), [len(b) for b in best])
        if len(items):
            yield _found_batch(items, np.concatenate(best_docs), np.concatenate(best))
    return run


def _reaching(queries: Queries, index: Index, least: list[int]):
    """Every document whose bound reaches the item's threshold."""
    size, floor = (index.documents, index.terms), np.maximum(np.array(least, dtype=np.float64), 1.0)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(queries, Index(None, *size))
        for ids, bound in _blocks_of(batches, bounds):
            items, columns = np.nonzero(bound >= floor)
            if len(items):
                yield _found_batch(items, ids[columns], bound[items, columns])
    return run


def _scorer(queries: Queries, index: Index):
    """Exact scores of candidates ``(doc_id, text, items)``; the ten best of each item per task."""
    place = {t: k for k, t in enumerate(queries.terms)}
    weight = queries.counts * queries.weights
    holders = [np.flatnonzero(weight[:, t]).tolist() for t in range(len(queries.terms))]
    documents, terms = index.documents, index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int, object]]] = [[] for _ in queries.items]
        serial = 0
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, items in zip(ids, batch.column(1).cast(pa.large_binary()), wanted, strict=True):
                words = terms_of(text.as_py() or b"")
                m = 25 + 75 * len(words) * documents // terms
                score = dict.fromkeys(items, 0)
                for term, tf in Counter(words).items():
                    t = place.get(term)
                    if t is not None:
                        factor = SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)
                        for i in holders[t]:
                            if i in score:
                                score[i] += int(weight[i, t]) * factor
                for i, points in score.items():
                    if points > 0:
                        # Highest score first, then the lowest id, null before all.
                        serial += 1
                        entry = (points, 1 if doc is None else 0, -(doc or 0), serial, doc)
                        (heapq.heappush if len(best[i]) < TOP else heapq.heappushpop)(best[i], entry)
        out = [(i, e[4], e[0]) for i, own in enumerate(best) for e in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64())], ["item", "doc_id", "score"])
    return run


def _scored(docs: DataFrame, candidates: DataFrame, queries: Queries, index: Index) -> DataFrame:
    """``(item, doc_id, score)``: ten best candidates of each item per task of the join.

    A document's candidacies become one row, at most as wide as the block of items.
    """
    wanted = candidates.groupBy("doc").agg(F.collect_set("item").alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "doc", F.coalesce("doc_id", F.lit(_NO_ID)))
    return rows.join(wanted, "doc").select("doc_id", "text", "items").mapInArrow(_scorer(queries, index), _BEST)


def _best(scored: DataFrame) -> list:
    """At most ten rows per item of the block, best first."""
    order = F.row_number().over(_by_item())
    return scored.withColumn("rank", order).where(F.col("rank") <= TOP).collect()


def _by_item() -> WindowSpec:
    return Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())


def candidates(docs: DataFrame, index: Index, queries: Queries) -> DataFrame:
    """``(item, doc, bound)``: written table of all documents not provably outside an item's ten best."""
    seeds = index.blocks.mapInArrow(_seeds(queries, index), _FOUND)
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc"))
    seeds = write_stage(seeds.withColumn("place", order).where(F.col("place") <= SEEDS), "seeds")
    least = [0] * len(queries.items)
    for row in _best(_scored(docs, seeds, queries, index)):
        if row["rank"] == TOP:
            least[row["item"]] = row["score"]
    return write_stage(index.blocks.mapInArrow(_reaching(queries, index, least), _FOUND), "candidates")


def search(docs: DataFrame, items: DataFrame, index: Index | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ten best documents of every item."""
    spark: SparkSession = docs.sparkSession
    index = build_index(docs) if index is None else index
    result = None
    for queries in query_blocks(items) if index.documents else ():
        queries = weigh(docs, index, queries)
        scored = _scored(docs, candidates(docs, index, queries), queries, index)
        ranked = scored.withColumn("rank", F.row_number().over(_by_item())).where(F.col("rank") <= TOP)
        names = spark.createDataFrame(list(enumerate(queries.items)), "item int, item_id long")
        part = write_stage(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
