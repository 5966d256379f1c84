"""Token counts by a map-side two-tier lookup.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so a text's
count is the sum over its pre-tokens. The first tier is a broadcast table of the lengths
of frequent pre-tokens, at most ``FREQUENT`` of them; what misses it is encoded
by the tokenizer itself, once per worker while a bounded cache holds it. No pre-token is
ever shuffled, and no length is guessed: the frequent table only saves work.

Texts holding the string of a special token go through the library whole, as its default
treats those strings apart. Null and empty texts have no bytes and no tokens. Repeated
rows are counted alike.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm.common import thinned

FREQUENT = 1 << 16
SAMPLE_ROWS = 2000
CACHE = 1 << 19
LIMIT = 1024

# The byte-level split pattern that the tokenizer file refers to.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[Tokenizer, list[str]]:
    """Tokenizer of a file and the strings of its added tokens; once per worker."""
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
        raise ValueError("two-tier counts need a byte-level tokenizer without normaliser or added space")
    return made, [t["content"] for t in spec["added_tokens"]]


#: Lengths of pre-tokens outside the frequent table, by tokenizer file; kept from task to task of a worker.
_seen: dict[str, dict[str, int]] = {}


class PreTokens:
    """Token counts by tiers: the shared table, then this worker's bounded cache, then the tokenizer."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.path, self.frequent = path, frequent
        self.cache = _seen.setdefault(path, {})
        self.find = regex.compile(PATTERN).findall

    def count(self, text: str) -> int:
        made, special = tokenizer(self.path)
        if any(s in text for s in special):
            return len(made.encode(text, add_special_tokens=False).ids)
        pieces = self.find(text)
        lengths = list(map(self.frequent.get, pieces))
        if None not in lengths:
            return sum(lengths)
        missed = [p for p, n in zip(pieces, lengths, strict=True) if n is None]
        if len(self.cache) + len(missed) > CACHE:
            self.cache.clear()
        fresh = [p for p in dict.fromkeys(missed) if p not in self.cache]
        for piece, coded in zip(fresh, made.encode_batch(fresh, add_special_tokens=False), strict=True):
            self.cache[piece] = len(coded.ids)
        return sum(n for n in lengths if n is not None) + sum(map(self.cache.__getitem__, missed))


def _sampler(path: str, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        find = regex.compile(PATTERN).findall
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(find(text))
        best = [p for p, n in counts.most_common(cap) if n > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best, pa.string()), pa.array([counts[p] for p in best], pa.int64())], ["piece", "n"])
    return run


def frequent_pieces(docs: DataFrame, path: str, cap: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``cap`` frequent pre-tokens of a bounded sample of texts.

    Which ones are chosen affects speed alone: every other pre-token is encoded on the spot.
    """
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    share = min(1.0, sample_rows / max(1, rows.count()))
    partial = thinned(rows, share).coalesce(8).select("text").mapInArrow(_sampler(path, cap), "piece string, n long")
    best = partial.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(cap)
    return [r["piece"] for r in best.collect()]  # ``cap`` rows at most


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text of ``docs(doc_id, text)``."""
    pieces = frequent_pieces(docs, path)
    made, _ = tokenizer(path)
    lengths = bytes(min(255, len(e.ids)) for e in made.encode_batch(pieces, add_special_tokens=False))
    table = docs.sparkSession.sparkContext.broadcast((pieces, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = PreTokens(path, {p: n for p, n in zip(*table.value, strict=True) if n < 255})
        for batch in batches:
            counts = [lookup.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # The byte lengths stay in the JVM; rows keep their order within a task.
    sized = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), "text")
    counted = sized.mapInArrow(run, f"doc_id struct<doc_id:{kind},n_bytes:bigint>, n_tokens long")
    return counted.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
