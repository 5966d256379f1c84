"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has an entropy, quantised to ``LEVELS`` levels. How rare a
level is, counted over all windows of all texts, ranks the windows; in each run of ``RUN``
windows the rarest (leftmost of equals) gains a point, and windows with ``POINTS`` or more are
the features. Their hashes are inserted, ``PER_FILTER`` at a time, into chained Bloom filters
of ``BITS`` bits with ``HASHES`` positions each. Likeness of two fingerprints is, for each filter
of the shorter chain, the best bit overlap with one of the other, normalised between what
chance gives and full overlap; then the mean.

Defined results: texts shorter than a window have one feature, the whole text; the
fingerprint of an empty or null text is the empty string, alike (1) to itself only and 0 to any
other. Equal texts have equal fingerprints. A null id orders below all others; rows of equal
id are ordered by a hash of their text. The next of a single document is itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm import arrays

WINDOW = 64
RUN = 64
POINTS = 16
LEVELS = 1000
WEAK = 100  # windows of less entropy than this level hardly tell texts apart
BITS, HASHES, PER_FILTER = 2048, 5, 160
FLOOR = 0.15
MOST_BUCKETS = 20_000

_FIXED = 1 << 14
_COUNT_LOG = np.rint(_FIXED * np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))).astype(np.int32)
_GAIN = _COUNT_LOG[1:] - _COUNT_LOG[:-1]
_TOP = int(_COUNT_LOG[WINDOW])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of the window that starts at each byte; windows slide over all of ``data``."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int32)
    order = np.argsort(data, kind="stable").astype(np.int64)
    spot = (data[order].astype(np.int64) << 32) | order
    low = np.searchsorted(spot, spot - (WINDOW - 1))
    at = np.arange(n)
    before = np.empty(n, dtype=np.int8)
    after = np.empty(n, dtype=np.int8)
    before[order] = at - low
    after[order] = np.cumsum(np.bincount(low, minlength=n)) - 1 - at
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    total[0] = _COUNT_LOG[np.bincount(data[:WINDOW])].sum()
    # Leaving byte i lowers its count from after[i] + 1; entering byte i + WINDOW raises before[.].
    np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[:-WINDOW]], out=total[1:])
    total[1:] += total[0]
    return ((_TOP - total) * (LEVELS / _TOP)).astype(np.int32)


def _windows_of(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each row."""
    return texts.bounds[:-1], np.maximum(np.diff(texts.bounds) - WINDOW + 1, 0)


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(LEVELS + 1, dtype=np.int64)
    for batch in batches:
        for texts in arrays.chunks(batch.column(0)):
            levels = entropy_levels(texts.data)
            first, count = _windows_of(texts)
            inside = np.zeros(len(levels) + 1, dtype=np.int32)
            np.add.at(inside, first[count > 0], 1)
            np.add.at(inside, (first + count)[count > 0], -1)
            seen += np.bincount(levels[np.cumsum(inside[:-1]) > 0], minlength=LEVELS + 1)
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["level", "n"])


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each level from the rarest (0) up, by its windows in all texts; weak levels come last."""
    counts = docs.select("text").mapInArrow(_level_counts, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    seen = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in counts.collect():  # LEVELS + 1 rows at most
        seen[row["level"]] = row["n"]
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), seen))] = np.arange(LEVELS + 1)
    ranks[:WEAK] += LEVELS + 1
    return ranks


def select_features(texts: arrays.Texts, ranks: np.ndarray) -> np.ndarray:
    """Start bytes of the improbable windows of all rows, in order."""
    levels = entropy_levels(texts.data)
    first, count = _windows_of(texts)
    if len(levels) == 0:
        return np.zeros(0, dtype=np.int64)
    keys = (ranks[levels] << 32) | np.arange(len(levels))
    padded = np.full(-(-(len(keys) + RUN) // RUN) * RUN, np.iinfo(np.int64).max)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, RUN)
    upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(onward[:len(keys)], upto[RUN - 1:RUN - 1 + len(keys)])
    runs = np.maximum(count - RUN + 1, 0)
    inside = np.zeros(len(keys) + 1, dtype=np.int32)
    np.add.at(inside, first[runs > 0], 1)
    np.add.at(inside, (first + runs)[runs > 0], -1)
    winners = least[np.cumsum(inside[:-1]) > 0] & ((1 << 32) - 1)
    chosen = np.bincount(winners, minlength=len(keys)) >= POINTS
    # Without one full run, or without any window ahead of the others, the rarest counts.
    tally = np.concatenate([[0], np.cumsum(chosen)])
    for i in np.flatnonzero((count > 0) & (tally[np.minimum(first + count, len(keys))] == tally[np.minimum(first, len(keys))])):
        chosen[keys[first[i]:first[i] + count[i]].min() & ((1 << 32) - 1)] = True
    return np.flatnonzero(chosen)


def fingerprint_filters(column: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, an array of ``BITS // 8`` bytes per filter."""
    out: list[np.ndarray] = []
    for texts in arrays.chunks(column):
        starts = select_features(texts, ranks)
        lengths = np.diff(texts.bounds)
        short = np.flatnonzero((lengths > 0) & (lengths < WINDOW))
        starts = np.sort(np.concatenate([starts, texts.bounds[:-1][short]]))
        rows = np.searchsorted(texts.bounds, starts, side="right") - 1
        ends = np.minimum(starts + WINDOW, texts.bounds[rows + 1])
        hashed = texts.span_hash(texts.prefix_hash(texts.data), starts, ends)
        # The first of equal features of a row counts.
        order = np.lexsort((starts, hashed, rows))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (hashed[order][1:] == hashed[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        kept = np.sort(order[~again])
        rows, hashed = rows[kept], hashed[kept]
        counts = np.bincount(rows, minlength=texts.rows)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        chains = -(-counts // PER_FILTER)
        offset = np.cumsum(chains) - chains
        target = (offset[rows] + place // PER_FILTER) * BITS
        bits = np.zeros(int(chains.sum()) * BITS, dtype=bool)
        for j in range(HASHES):
            bits[target + ((hashed >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits.reshape(-1, BITS), axis=1)
        out += [packed[offset[i]:offset[i] + chains[i]] for i in range(texts.rows)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap of two chains of filters, 0 to 1."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = []
    for one, size in zip(a, size_a, strict=True):
        common = np.bitwise_count(one & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(size, size_b)
        chance = size * size_b / BITS
        low = chance + FLOOR * (most - chance)
        best.append(float(np.clip((common - low) / np.maximum(most - low, 1e-9), 0, 1).max()))
    return sum(best) / len(best)


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, BITS // 8)


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(f) for f in fingerprint_filters(batch.column(1), ranks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _bucket_of(splits: list[int]) -> Column:
    """How many splits are at or below ``_order``, in two levels of comparisons."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    every = literal(splits)
    coarse = F.size(F.filter(literal(splits[step - 1::step]), lambda s: s <= F.col("_order"))) * step
    fine = F.size(F.filter(F.slice(every, coarse + 1, F.lit(step)), lambda s: s <= F.col("_order")))
    return (coarse + fine).cast("int")


def with_next(docs: DataFrame, per_bucket: int = 4000) -> DataFrame:
    """``docs`` dealt by ranges of descending id for a pass over neighbours.

    Rows ``(_bucket, _look, doc_id, text)`` sorted within a bucket; the last row of a bucket, marked
    ``_look``, is the first one of the bucket that follows it (of the first, after the last).
    Driver and plan hold one split point per ``per_bucket`` documents, ``MOST_BUCKETS`` at most.
    """
    least = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "_order", F.coalesce("doc_id", F.lit(least)))
    count = keyed.count()
    parts = min(MOST_BUCKETS, max(1, count // per_bucket))
    splits = sorted({int(x) for x in keyed.approxQuantile("_order", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    dealt = keyed.withColumn("_bucket", _bucket_of(splits))
    tops = {r["_bucket"]: r["top"] for r in dealt.groupBy("_bucket").agg(F.max("_order").alias("top")).collect()}
    filled = sorted(tops)
    # A bucket's top row is also what the next higher bucket (the lowest one, for the highest) looks ahead to.
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    size = max(filled, default=0) + 1
    top = F.element_at(literal([tops.get(b, 0) for b in range(size)]), F.col("_bucket") + 1)
    upper = F.element_at(literal([above.get(b, 0) for b in range(size)]), F.col("_bucket") + 1).cast("int")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("look"))
    ahead = F.struct(upper.alias("b"), F.lit(1).alias("look"))
    both = dealt.withColumn("_at", F.explode(F.when(F.col("_order") == top, F.array(own, ahead)).otherwise(F.array(own))))
    rows = both.select(F.col("_at.b").alias("_bucket"), F.col("_at.look").alias("_look"), "_order", "doc_id", "text")
    return rows.repartition(max(1, len(filled)), "_bucket").sortWithinPartitions(
        "_bucket", "_look", F.desc("_order"), F.xxhash64("text"), "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters (or all) of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compared(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``RESULT``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                table = pa.Table.from_batches([batch.slice(low, 1000)])
                if carry is not None:
                    table = pa.concat_tables([carry, table])
                carry = table.slice(table.num_rows - 1)
                bucket, look = table.column(0).to_numpy(), table.column(1).to_numpy()
                real = np.flatnonzero((bucket[:-1] == bucket[1:]) & (look[:-1] == 0))
                if len(real) == 0:
                    continue
                text = [t or "" for t in table.column("text").to_pylist()]
                edited = [edited_text(text[i], text[i + 1]) for i in real]
                own = fingerprint_filters(pa.array(text, pa.large_string()), ranks)
                changed = fingerprint_filters(pa.array(edited, pa.large_string()), ranks)
                doc = table.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(real)), pa.array([len(text[i]) for i in real], pa.int64()),
                     pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                     pa.array([as_text(own[i]) for i in real], pa.string()),
                     pa.array([as_text(f) for f in changed], pa.string()),
                     pa.array([likeness(own[i], f) for i, f in zip(real, changed, strict=True)], pa.float64()),
                     pa.array([likeness(own[i], own[i + 1]) for i in real], pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).select("_bucket", "_look", "doc_id", "text").mapInArrow(run, RESULT)
