"""Token counts against the library, shards against an exact round trip."""

import numpy as np
import pytest
import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandweave.llm import token_counts as tc
from strandweave.llm import training_order as to

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(documents, odd, clashing, nothing, library):
    for docs in (documents, odd):
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()),
                       len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(docs, PATH).collect())
        assert got == want
    assert tc.token_counts(clashing, PATH).count() == odd.count()
    assert tc.token_counts(nothing, PATH).count() == 0
    assert {r["over_limit"] for r in tc.token_counts(odd, PATH).collect()} == {True, False}


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x1f\x85\xa0 'sStTdmlvre09²½Ⅷab.é́中!_"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(library, text):
    assert tc.PreTokens(PATH, {" the": 1}).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_bounded_cache(documents, monkeypatch, library):
    monkeypatch.setattr(tc, "CACHE", 50)
    tc._seen.clear()
    counter = tc.PreTokens(PATH, {})
    for r in documents.limit(20).collect():
        assert counter.count(r["text"]) == len(library.encode(r["text"], add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 100, 1000, 4097])
def test_permutation_is_a_bijection(size):
    slots = to.permute(np.arange(size), size, 99)
    assert sorted(slots.tolist()) == list(range(size))
    if size >= 64:
        assert (slots != np.arange(size)).mean() > 0.9
        assert (to.permute(np.arange(size), size, 100) != slots).mean() > 0.9


def round_trip(docs, out=None, **kw):
    """Records in order of slots, and the texts found by joining them in order of ordinals."""
    index, folder, layout = to.materialise(docs, RANKS, out=out, **kw)
    records = list(to.read_slots(folder))
    assert [r[0] for r in records] == list(range(layout.sequences)) == sorted(r["slot"] for r in index.collect())
    slots = to.permute(np.arange(layout.sequences), layout.sequences, layout.key)
    stream = np.concatenate([records[s][3] for s in slots] or [np.zeros(0, dtype=np.int64)])
    ends = np.flatnonzero(stream == layout.pad)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else []
    made = to.encoder(RANKS)
    texts = [made.decode(stream[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
    assert len(stream) == (ends[-1] + 1 if len(ends) else 0)
    assert sorted(texts) == sorted(r["text"] or "" for r in docs.collect())
    return records, folder, layout


def test_round_trip(documents, tmp_path):
    records, folder, layout = round_trip(documents, str(tmp_path / "shards"), seq_len=64, per_shard=100)
    assert layout.shards == -(-layout.sequences // 100)
    sizes = [p.stat().st_size for p in sorted((tmp_path / "shards").glob("shard-*.bin"))]
    assert sizes[:-1] == [100 * layout.stride] * (layout.shards - 1)
    assert len(list((tmp_path / "shards").iterdir())) == layout.shards + 1, "temporary files remain"
    middle = layout.sequences // 2 + 3
    for a, b in zip(to.read_slots(folder, middle, 150), records[middle:middle + 150], strict=True):
        assert a[:3] == b[:3] and (a[3] == b[3]).all()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    made = to.encoder(RANKS)
    for _, doc, start, ids in records[::7]:
        whole = [*made.encode_ordinary(texts[doc]), layout.pad]
        own = whole[start:start + len(ids)]
        assert ids[:len(own)].tolist() == own


def test_same_key_same_order(documents):
    few = documents.where("doc_id < 50")
    a = [r[1:3] for r in round_trip(few, seq_len=64)[0]]
    b = [r[1:3] for r in round_trip(few, seq_len=64)[0]]
    c = [r[1:3] for r in round_trip(few, seq_len=64, key=1)[0]]
    assert a == b != c


def test_odd_rows(odd, clashing, nothing):
    _, _, layout = round_trip(odd, seq_len=32, per_shard=7)
    assert round_trip(clashing, seq_len=32)[2].sequences == layout.sequences
    assert round_trip(nothing)[2].sequences == 0
    assert round_trip(odd)[2].sequences > 0


@pytest.mark.parametrize("seq_len", [32, 2048])
def test_every_document_by_its_id(documents, odd, tmp_path, seq_len):
    made = to.encoder(RANKS)
    for name, docs in (("documents", documents), ("odd", odd)):
        out = str(tmp_path / name)
        index, folder, layout = to.materialise(docs, RANKS, seq_len=seq_len, per_shard=50, out=out)
        records = list(to.read_slots(folder))
        listed = list(to.read_docs(folder))
        assert [s for s, _ in listed] == list(range(layout.sequences))
        rows = {r["slot"]: list(zip(r["doc_ids"], r["doc_offsets"], r["doc_lengths"], strict=True)) for r in index.collect()}
        assert {s: x.tolist() for s, x in listed} == rows
        middle = layout.sequences // 2 + 1
        assert [(s, x.tolist()) for s, x in to.read_docs(folder, middle, 60)] == [(s, rows[s]) for s in range(middle, min(middle + 60, layout.sequences))]
        by_doc, held = {}, []
        for slot in to.permute(np.arange(layout.sequences), layout.sequences, layout.key):
            _, head, start, ids = records[slot]
            assert rows[slot][0][0] == head and sum(n for _, _, n in rows[slot]) == len(ids) and start == len(held)
            for doc, offset, n in rows[slot]:
                held += ids[offset:offset + n].tolist()
                if held[-1] == layout.pad:
                    by_doc.setdefault(doc, []).append(made.decode(held[:-1]))
                    held = []
        assert not held
        want = {}
        for r in docs.collect():
            want.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r["text"] or "")
        assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(x) for d, x in want.items()}
