"""Jaccard join on word shingles with Bayesian candidate pruning.

Texts with equal shingle sets form a class of copies, represented once. Candidates are
pairs of classes that agree in at least one of ``BANDS`` groups of ``ROWS`` MinHash values. A
candidate's MinHash values are compared ``STEP`` at a time: with a uniform prior, the
posterior that the similarity reaches the threshold is a binomial tail of the matches
so far, and the pair is dropped once it falls below ``TOLERANCE``. What survives is verified
exactly on the shingle sets.

No bucket or group is ever expanded into rows of pairs. A bucket first links its
members to its least one; members that stay in different components are compared across
components inside tasks that return a spanning forest. So each surviving candidate lies inside one cluster, whose texts then meet
in blocks of at most ``BLOCK`` classes (a large cluster is dealt over pairs of blocks), and a
block returns a row per class: its number of links and its root.

Defined results: words are lower-cased runs of letters and digits; fewer than five words
make one shingle; texts without words (null and empty ones too) are classes of their own
without links. Repeated rows and copies are linked. A null ``doc_id`` is the least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import arrays
from strandweave.llm.common import unused_name
from strandweave.llm.components import connected_components
from strandweave.session import write_stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
STEP = 25
TOLERANCE = 1e-4
BLOCK = 256

_FACTORS = np.random.default_rng(2024).integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_rows(texts: arrays.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of each row in order of words, and row bounds."""
    data = arrays.ASCII_LOWER[texts.data]
    starts, ends, bounds = texts.words(arrays.ALNUM)
    words = texts.span_hash(texts.prefix_hash(data), starts, ends)
    counts = np.diff(bounds)
    out = np.zeros(len(words), dtype=np.uint64)
    full = arrays.shingle_hash(words, size)
    out[:len(full)] = full
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[bounds[i]] = arrays.shingle_hash(words[bounds[i]:bounds[i + 1]], int(counts[i]))[0]
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    position = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    return out[position < np.repeat(sizes, counts)], np.concatenate([[0], np.cumsum(sizes)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set identity, size, MinHash values and band keys of each text."""
    for batch in batches:
        one, two, sizes, signs, bands = [], [], [], [], []
        for texts in arrays.chunks(batch.column(2)):
            shingles, bounds = shingle_rows(texts)
            # Distinct per row: the row number above 48 bits of the hash sorts both at once.
            keys = np.unique((arrays.row_of(bounds).astype(np.uint64) << np.uint64(48)) | (shingles >> np.uint64(16)))
            bounds = np.searchsorted(keys, np.arange(texts.rows, dtype=np.uint64) << np.uint64(48))
            bounds = np.append(bounds, len(keys))
            own = keys & np.uint64((1 << 48) - 1)
            filled = np.flatnonzero(np.diff(bounds))
            sign = np.zeros((texts.rows, HASHES), dtype=np.uint32)
            totals = np.zeros((2, texts.rows), dtype=np.uint64)
            if len(filled):
                at = bounds[:-1][filled]
                base = (own >> np.uint64(16)).astype(np.uint32)
                for j in range(HASHES):
                    x = base * _FACTORS[j]
                    x ^= x >> np.uint32(16)
                    sign[filled, j] = np.minimum.reduceat(x, at)
                totals[0, filled] = np.add.reduceat(arrays.mix(own), at)
                totals[1, filled] = np.add.reduceat(arrays.mix(own + arrays.CLASS), at)
            one.append(totals[0])
            two.append(totals[1])
            sizes.append(np.diff(bounds))
            signs += [row.tobytes() for row in sign]
            bands.append(band_keys(sign))
        join = lambda parts, kind: np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=kind)
        keys = join(bands, np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(join(one, np.int64)), pa.array(join(two, np.int64)),
             pa.array(join(sizes, np.int64)), pa.array(signs, pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys, pa.int64()))],
            ["doc_id", "text_hash", "set1", "set2", "n_shingles", "sign", "bands"])


def band_keys(sign: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    out = np.empty((len(sign), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        x = np.full(len(sign), b + 1, dtype=np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            x = arrays.mix(x * arrays.CLASS + sign[:, j].astype(np.uint64))
        out[:, b] = x
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """For each number of compared values, the matches below which a pair is dropped.

    With a uniform prior, m matches of n give a Beta(m + 1, n - m + 1) posterior, whose tail
    above the threshold is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs ``(a[left], b[right])`` of signatures stay, comparing a step of values at a time."""
    kept, matches, low = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, least in least_matches(threshold, TOLERANCE):
        matches = matches + (a[left[kept], low:n] == b[right[kept], low:n]).sum(axis=1)
        stay = matches >= least
        kept, matches, low = kept[stay], matches[stay], n
    return kept


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(u, v)`` of classes whose posterior stays above the tolerance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _signatures(batch.column(2)), _signatures(batch.column(3))
            rows = np.arange(batch.num_rows)
            kept = pa.array(surviving(a, b, rows, rows, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "v"])

    signs = classes.select("cid", "sign")
    both = (pairs.join(signs.select(F.col("cid").alias("u"), F.col("sign").alias("a")), "u")
            .join(signs.select(F.col("cid").alias("v"), F.col("sign").alias("b")), "v"))
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def candidate_clusters(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(cid, label)``: components of surviving candidates. Every surviving candidate lies inside one."""
    rows = classes.select("cid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead < last")
    rows = write_stage(rows.join(shared.select("key", "lead"), "key"), "buckets")
    stars = rows.where("cid > lead").select(F.col("lead").alias("u"), F.col("cid").alias("v")).distinct()
    links = write_stage(_pruned(stars, classes, threshold), "links")
    found = write_stage(connected_components(links), "labels")
    # Members of a bucket that are still in different components are compared across them.
    labelled = rows.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = labelled.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"),
        F.ceil(F.count("*") / F.lit(2 * BLOCK)).cast("int").alias("n_blocks")).where("least < most")
    apart = labelled.join(mixed.select("key", "n_blocks"), "key").join(classes.select("cid", "sign"), "cid")
    more = write_stage(_cross_links(apart, threshold), "links")
    if more.isEmpty():
        return found
    return write_stage(connected_components(links.unionByName(more)), "labels")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, cid, n_blocks, ...)`` copied to every pair of blocks they take part in, in sorted groups."""
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    paired = blocked.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "n_blocks")
    return paired.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _cross_links(apart: DataFrame, threshold: float) -> DataFrame:
    """Links ``(u, v)`` between components that share a bucket; of a block's links a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["key", "low", "high"]):
            cid, label, block = (group.column(c).to_numpy() for c in ("cid", "label", "block"))
            first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            if group.column("low")[0].as_py() != group.column("high")[0].as_py() and block.min() == block.max():
                continue
            i, j = np.nonzero(label[first][:, None] != label[second][None, :])
            left, right = first[i], second[j]
            sign = _signatures(group.column("sign").combine_chunks())
            kept = surviving(sign, sign, left, right, threshold)
            distinct, part = np.unique(label, return_inverse=True)
            parent, out = np.arange(len(distinct)), []
            for a, b in zip(left[kept].tolist(), right[kept].tolist(), strict=True):
                x, y = _root(parent, int(part[a])), _root(parent, int(part[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((cid[a], cid[b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    rows = _dealt(apart.select("key", "cid", "label", "sign", "n_blocks"), "key")
    return rows.select("key", "low", "high", "cid", "label", "block", "sign").mapInArrow(run, "u long, v long")


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(sets: list[np.ndarray], sign: np.ndarray, bands: np.ndarray, side: np.ndarray,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs ``(i, j)`` between members of both sides (of one side if there is only one)."""
    first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    share = np.zeros((len(first), len(second)), dtype=bool)
    for b in range(BANDS):
        share |= bands[first, b][:, None] == bands[second, b][None, :]
    if side.min() == side.max():
        share &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
    i, j = np.nonzero(share)
    left, right = first[i], second[j]
    kept = surviving(sign, sign, left, right, threshold)
    left, right = left[kept], right[kept]
    sizes = np.array([len(s) for s in sets])
    fits = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right])
    left, right = left[fits], right[fits]
    if len(left) > 4 * len(sets):
        common = _common_counts(sets)[left, right]
    else:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                           for a, b in zip(left, right, strict=True)], dtype=np.int64)
    ok = common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9
    return left[ok], right[ok]


def _common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of membership matrices a slice at a time."""
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, len(vocabulary), width):
        a, b = np.searchsorted(column, [low, low + width])
        member = np.zeros((len(sets), width), dtype=np.float32)
        member[row[a:b], column[a:b] - low] = 1
        out += member @ member.T
    return np.rint(out).astype(np.int64)


def _verify_group(group: pa.Table, threshold: float) -> list[tuple[int, int, int]]:
    """``(class, linked documents, root class)`` for each linked class of a block."""
    group = group.combine_chunks()
    sets: list[np.ndarray] = []
    for texts in arrays.chunks(group.column("text")):
        shingles, bounds = shingle_rows(texts)
        sets += [np.unique(shingles[bounds[i]:bounds[i + 1]]) for i in range(texts.rows)]
    cid, weight = group.column("cid").to_numpy(), group.column("n_rows").to_numpy()
    side = group.column("block").to_numpy()
    sign = _signatures(group.column("sign").combine_chunks())
    left, right = block_links(sets, sign, band_keys(sign), side, threshold)
    links = (np.bincount(left, weights=weight[right], minlength=len(cid))
             + np.bincount(right, weights=weight[left], minlength=len(cid)))
    parent = np.arange(len(cid))
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = _root(parent, a), _root(parent, b)
        parent[max(a, b)] = min(a, b)
    return [(int(cid[i]), int(links[i]), int(cid[_root(parent, int(i))])) for i in np.flatnonzero(links)]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, across batch bounds; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """``(cid, n, root)`` rows of exactly verified links, from each block of each cluster."""
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n_blocks"))
    member = clusters.withColumnRenamed("node", "cid").join(sizes, "label")
    chosen = member.join(classes, "cid").select(
        "label", "cid", "n_blocks", "n_rows", "sign", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    on = chosen["doc_id"].eqNullSafe(texts["doc_id"]) & (chosen["text_hash"] == texts["text_hash"])
    found = chosen.join(texts, on).select(chosen["label"], "cid", "n_blocks", "n_rows", "sign", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["label", "low", "high"]):
            if group.num_rows < 2:
                continue
            # Repeated rows of one document bring its text several times.
            group = group.take(pa.array(np.unique(group.column("cid").to_numpy(), return_index=True)[1]))
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            if low != high and len(set(group.column("block").to_pylist())) < 2:
                continue
            out = _verify_group(group, threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["cid", "n", "root"])

    rows = _dealt(found, "label").select("label", "low", "high", "cid", "block", "n_rows", "sign", "text")
    return rows.mapInArrow(run, "cid long, n long, root long")


def shingle_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and the classes of rows with equal shingle sets; both written."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    signed = write_stage(keyed.mapInArrow(
        _sign, "doc_id long, text_hash long, set1 long, set2 long, n_shingles long, sign binary, bands array<long>"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("set1", "set2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n_rows"),
        F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    return signed, write_stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def linked_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Signatures, and ``(set1, set2, rep, keeper, n_links)`` of every class of copies."""
    signed, classes = shingle_classes(docs)
    clusters = candidate_clusters(classes, threshold)
    links = write_stage(_verified(docs, classes, clusters, threshold), "verified")
    labels = connected_components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    narrow = classes.select("cid", "set1", "set2", "rep", "n_rows")
    joined = narrow.join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left").select(
        "set1", "set2", "rep", F.coalesce("label", "cid").alias("label"),
        (F.col("n_rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    joined = write_stage(joined, "linked")
    keepers = joined.groupBy("label").agg(F.min("rep").alias("keeper"))
    return signed, joined.join(keepers, "label").drop("label")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, n_links, n_shingles)`` per row of ``docs(doc_id, text)``.

    ``class_id`` is the least id of the group of documents connected by links; ``n_links`` is how
    many other documents reach the threshold with this one, copies included.
    """
    signed, linked = linked_classes(docs, threshold)
    rows = signed.select("doc_id", "set1", "set2", "n_shingles")
    both = rows.join(linked.withColumn("known", F.lit(True)), ["set1", "set2"], "left")
    return both.select(
        "doc_id", F.when(F.col("known") & (F.col("n_shingles") > 0), F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "n_shingles")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of linked documents, the one of least id; columns unchanged.

    Rows without words stay.
    """
    signed, linked = linked_classes(docs, threshold)
    keepers = linked.select("keeper").distinct().select("keeper.*")
    wordless = signed.where("n_shingles = 0").select("doc_id", "text_hash")
    rows = signed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_rows"))
    kept = keepers.withColumn("_once", F.lit(True)).unionByName(
        wordless.distinct().withColumn("_once", F.lit(False)))
    flag = unused_name(docs, "_again")
    kept = kept.join(rows.where("_rows > 1"), (kept["doc_id"].eqNullSafe(rows["doc_id"])) & (kept["text_hash"] == rows["text_hash"]), "left").select(
        kept["doc_id"].alias("_id"), kept["text_hash"].alias("_hash"), (F.col("_once") & (F.coalesce("_rows", F.lit(1)) > 1)).alias(flag))
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]))
    single = found.where(~kept[flag]).select(*[docs[c] for c in docs.columns])
    mine, number = unused_name(docs, "_id_again"), unused_name(docs, "_hash_again")
    again = found.where(kept[flag]).select(*[docs[c] for c in docs.columns], kept["_id"].alias(mine), kept["_hash"].alias(number)).dropDuplicates(
        [mine, number]).drop(mine, number)
    return single.unionByName(again)
