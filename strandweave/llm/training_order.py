"""Materialise tokenised sequences in a keyed random order as fixed-stride shards.

Texts are tokenised once, by the ranks file of a byte-level encoder. A task joins its texts, each
closed by the end token, and cuts the stream into sequences of ``seq_len`` tokens (its last may
be shorter), which it keeps in a written table; so every sequence has an ordinal. A keyed
Feistel network permutes ``0 .. n-1``: the ordinal is encrypted in the least even number of
bits that holds n and, while the result is n or more, encrypted again (cycle-walking).
That slot is the sequence's place in training order. Slots are dealt by ranges to tasks,
each of which writes whole shards of ``per_shard`` records of equal length, so
record i of the order lies at a computed byte offset; a reader streams, or resumes at any slot.

Shards appear under a temporary name and are renamed when complete; a task that is
run again writes the same bytes. A record is doc_id (8 bytes), start (4), tokens (4), then
``seq_len`` token ids padded with the end token (the first id past the ranks), little-endian; doc_id is
the document of the first token and start that token's place in it. All documents of a record
are in the index (``doc_ids``, ``doc_offsets``, ``doc_lengths``: a piece per document, its place in the record and
its tokens, the end token included) and, so that shards can be read without it, in a file
per shard of the folder beside them (``<out>.docs``): doc_id (8), offset (4) and length (4) of
each piece, then the number of pieces before each record and in all (8 each). All
pieces but a record's first begin their document.

Defined results: null and empty texts add just the end token; a null doc_id
is stored as -1. Repeated rows are tokenised as often as they occur. No rows: no shards.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.token_counts import PATTERN
from strandweave.session import stage_path, write_stage

ROUNDS = 6
HEADER = 16
PIECE = np.dtype([("doc_id", "<i8"), ("offset", "<i4"), ("length", "<i4")])
LEVEL, SHUFFLE_LEVEL = 6, 3  # of zstd: for token tables, whose pages gain by it, and for single sequences, which hardly do


@dataclass
class Layout:
    """What a reader must know; stored as ``layout.json`` beside the shards."""

    sequences: int
    seq_len: int
    per_shard: int
    token_bytes: int
    pad: int
    key: int

    @property
    def stride(self) -> int:
        return HEADER + self.seq_len * self.token_bytes

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2" if self.token_bytes == 2 else "<u4")


def _round_keys(key: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh64_intdigest(r.to_bytes(4, "little"), seed=key & ((1 << 64) - 1))) for r in range(ROUNDS)]


def _scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute(ordinals: np.ndarray, size: int, key: int) -> np.ndarray:
    """Keyed permutation of ``0 .. size-1``: a balanced Feistel network with cycle-walking."""
    half = np.uint64(max(1, -(-max(size - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)
    out = np.asarray(ordinals, dtype=np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_scramble(right, k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(size)]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """Byte-pair encoder of a file of ranks (base64 token and rank a line); once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def tokenised(docs: DataFrame, path: str, seq_len: int, end: int, id_type: np.dtype) -> DataFrame:
    """Written table of ``(task, place, start, doc_ids, ids)``: ``place`` numbers the task's sequences."""
    code = id_type.char

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        task, place, before = TaskContext.get().partitionId(), 0, 0  # before: tokens of the first held document already cut off
        held, docs_held = [np.zeros(0, dtype=id_type)], []

        def cut(last: bool) -> pa.RecordBatch:
            """Sequences of what is held; but for the last time, the rest is held on."""
            nonlocal place, before
            ids, doc = np.concatenate(held), np.array(docs_held, dtype=np.int64)
            ends = np.flatnonzero(ids == end) + 1  # a document's end token is its only one
            begins = np.concatenate([[-before], ends])
            count = -(-len(ids) // seq_len) if last else len(ids) // seq_len
            rest = min(count * seq_len, len(ids))
            heads = np.arange(count) * seq_len
            first = np.searchsorted(ends, heads, side="right")
            past = np.searchsorted(ends, np.minimum(heads + seq_len, len(ids)) - 1, side="right") + 1
            found = np.concatenate([np.zeros(0, dtype=np.int64), *[doc[a:b] for a, b in zip(first, past, strict=True)]])
            starts = heads - begins[first]
            gone = int(np.searchsorted(ends, rest, side="right"))
            before = rest - int(begins[gone])
            held[:], docs_held[:] = [ids[rest:]], docs_held[gone:]
            places = np.arange(place, place + count)
            place += count
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * count, pa.int32()), pa.array(places, pa.int64()), pa.array(starts, pa.int32()), _lists(found, past - first),
                 pa.array([ids[h:h + seq_len].tobytes() for h in heads], pa.binary())], ["task", "place", "start", "doc_ids", "ids"])

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = made.encode_ordinary(text or "")
                    ids.append(end)
                    held.append(np.frombuffer(array(code, ids), dtype=id_type))
                    docs_held.append(doc)
                yield cut(False)
        yield cut(True)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text")
    found = rows.mapInArrow(run, "task int, place long, start int, doc_ids array<long>, ids binary")
    out = stage_path(docs.sparkSession, "tokens")
    found.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(out)
    return docs.sparkSession.read.schema(found.schema).parquet(out)


def _placed(layout: Layout, bases: dict[int, int]):
    """Sequences with their shard and slot; token ids, and before them doc_ids as differences, travel compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=SHUFFLE_LEVEL)
        for batch in batches:
            base = np.array([bases[t] for t in batch.column(0).to_pylist()], dtype=np.int64)
            slot = permute(base + batch.column(1).to_numpy(), layout.sequences, layout.key)
            packed = [packer.compress(np.diff(np.array(d, dtype="<i8"), prepend=0).tobytes() + x)
                      for d, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot // layout.per_shard).astype(np.int32)), pa.array(slot), batch.column(2),
                 pa.array([len(d) for d in batch.column(3)], pa.int32()), pa.array(packed, pa.binary())], ["shard", "slot", "start", "docs", "packed"])
    return run


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def docs_folder(folder: str) -> str:
    """Folder of the documents of each record, beside that of the shards."""
    return folder.rstrip("/") + ".docs"


def _pieces(ids: np.ndarray, docs: np.ndarray, end: int) -> np.ndarray:
    """The documents of one record, with offset and length of each."""
    bounds = np.flatnonzero(ids == end) + 1
    if not len(bounds) or bounds[-1] < len(ids):
        bounds = np.append(bounds, len(ids))
    out = np.empty(len(docs), dtype=PIECE)
    out["doc_id"], out["offset"], out["length"] = docs, np.concatenate([[0], bounds[:-1]]), np.diff(bounds, prepend=0)
    return out


def _writer(layout: Layout, out: str):
    """Write each shard of a task, and the documents in it, from its records in order of slots; one index row per record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(out)
        opener = zstandard.ZstdDecompressor()
        pad = np.array([layout.pad], dtype=layout.id_type).tobytes()
        width = layout.seq_len * layout.token_bytes
        shard, open_files, counts = -1, [], []

        def finish() -> None:
            if open_files:
                open_files[0][0].write(np.cumsum([0, *counts]).astype("<i8").tobytes())
            for sink, temporary, name in open_files:
                sink.close()
                store.move(temporary, name)

        for batch in batches:
            shards, slots, starts, sizes = (batch.column(i).to_pylist() for i in range(4))
            raw = [opener.decompress(x) for x in batch.column(4).to_pylist()]
            records = [x[8 * n:] for x, n in zip(raw, sizes, strict=True)]
            pieces = [_pieces(np.frombuffer(ids, dtype=layout.id_type), np.cumsum(np.frombuffer(x, dtype="<i8", count=n)), layout.pad)
                      for x, ids, n in zip(raw, records, sizes, strict=True)]
            for s, start, ids, piece in zip(shards, starts, records, pieces, strict=True):
                if s != shard:
                    finish()
                    shard, counts = s, []
                    open_files = [(store.open_output_stream(t, buffer_size=1 << 20), t, shard_name(f, s))
                                  for f in (docs_folder(folder), folder) for t in [f"{f}/.{s}-{uuid.uuid4().hex}"]]
                open_files[0][0].write(piece.tobytes())
                counts.append(len(piece))
                open_files[1][0].write(int(piece["doc_id"][0]).to_bytes(8, "little", signed=True) + start.to_bytes(4, "little")
                                       + (len(ids) // layout.token_bytes).to_bytes(4, "little") + ids
                                       + pad * ((width - len(ids)) // layout.token_bytes))
            if not records:
                continue
            joined, many = np.concatenate(pieces), np.array(sizes)
            lengths = [len(x) // layout.token_bytes for x in records]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array([s % layout.per_shard * layout.stride for s in slots], pa.int64()),
                 pa.array([x["doc_id"][0] for x in pieces], pa.int64()), batch.column(2), pa.array(lengths, pa.int32()),
                 pa.array([xxhash.xxh64_intdigest(x) >> 1 for x in records], pa.int64()),
                 *[_lists(np.ascontiguousarray(joined[c]), many) for c in ("doc_id", "offset", "length")]],
                ["slot", "shard", "offset", "doc_id", "start", "n_tokens", "ids_hash", "doc_ids", "doc_offsets", "doc_lengths"])
        finish()
    return run


INDEX = "slot long, shard int, offset long, doc_id long, start int, n_tokens int, ids_hash long, doc_ids array<long>, doc_offsets array<int>, doc_lengths array<int>"


def materialise(docs: DataFrame, path: str, *, seq_len: int = 2048, per_shard: int = 1 << 12, key: int = 20240229,
                out: str | None = None) -> tuple[DataFrame, str, Layout]:
    """Write ``docs(doc_id, text)`` as shards below ``out``; returns the index table, the folder and the layout.

    ``out`` is a fresh folder in the shared folder unless named.
    """
    spark = docs.sparkSession
    end = encoder(path).max_token_value + 1
    id_type = np.dtype("<u2" if end < 1 << 16 else "<u4")
    tokens = tokenised(docs, path, seq_len, end, id_type)
    bases, total = {}, 0
    for r in tokens.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect():  # a row per task
        bases[r["task"]], total = total, total + r["n"]
    layout = Layout(total, seq_len, per_shard, id_type.itemsize, end, key)
    out = out or stage_path(spark, "shards")
    store, folder = _store(out)
    for made in (folder, docs_folder(folder)):
        store.create_dir(made, recursive=True)
    with store.open_output_stream(f"{folder}/layout.json") as f:
        f.write(json.dumps(asdict(layout)).encode())
    records = tokens.mapInArrow(_placed(layout, bases), "shard int, slot long, start int, docs int, packed binary")
    dealt = records.repartitionById(max(1, layout.shards), F.col("shard")).sortWithinPartitions("slot")  # a shard is a range of slots and a task
    return write_stage(dealt.mapInArrow(_writer(layout, out), INDEX), "index"), out, layout


def _layout(store: pafs.FileSystem, folder: str) -> Layout:
    with store.open_input_stream(f"{folder}/layout.json") as f:
        return Layout(**json.loads(f.read()))


def read_docs(out: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """``(slot, pieces)`` in training order: ``doc_id``, ``offset`` and ``length`` of each document in a record."""
    store, folder = _store(out)
    layout = _layout(store, folder)
    last = layout.sequences if count is None else min(layout.sequences, first + count)
    while first < last:
        shard, within = divmod(first, layout.per_shard)
        here = min(layout.per_shard, layout.sequences - shard * layout.per_shard)
        upto = min(last, (shard + 1) * layout.per_shard)
        with store.open_input_file(shard_name(docs_folder(folder), shard)) as f:
            f.seek(f.size() - 8 * (here + 1 - within))
            bounds = np.frombuffer(f.read(8 * (upto - first + 1)), dtype="<i8")
            f.seek(int(bounds[0]) * PIECE.itemsize)
            for slot in range(first, upto):
                yield slot, np.frombuffer(f.read(int(bounds[slot - first + 1] - bounds[slot - first]) * PIECE.itemsize), dtype=PIECE)
        first = upto


def read_slots(out: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(slot, doc_id, start, token ids)`` in training order, starting at any slot."""
    store, folder = _store(out)
    layout = _layout(store, folder)
    last = layout.sequences if count is None else min(layout.sequences, first + count)
    while first < last:
        shard, within = divmod(first, layout.per_shard)
        upto = min(last, (shard + 1) * layout.per_shard)
        with store.open_input_file(shard_name(folder, shard)) as f:
            f.seek(within * layout.stride)
            for slot in range(first, upto):
                record = f.read(layout.stride)
                n = int.from_bytes(record[12:16], "little")
                yield (slot, int.from_bytes(record[:8], "little", signed=True), int.from_bytes(record[8:12], "little"),
                       np.frombuffer(record, dtype=layout.id_type, count=n, offset=HEADER))
        first = upto
