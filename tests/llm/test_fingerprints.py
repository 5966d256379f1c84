"""Fingerprints: entropies and neighbours against plain code, likeness of copies and edits."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import fingerprints as fp


def test_entropy_levels():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 105, 300), np.full(100, 65), rng.integers(0, 256, 300)]).astype(np.uint8)
    levels = fp.entropy_levels(data)
    assert len(levels) == len(data) - fp.WINDOW + 1
    for i in range(0, len(levels), 7):
        n = Counter(data[i:i + fp.WINDOW].tolist())
        h = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in n.values()) / 6 * fp.LEVELS
        assert abs(levels[i] - h) <= 1.01


def plain_features(data, ranks):
    """Selected windows of one text, run by run."""
    levels = fp.entropy_levels(data)
    keys = [(ranks[x], i) for i, x in enumerate(levels)]
    if len(keys) < fp.RUN:
        return [min(keys)[1]] if keys else []
    points = Counter(min(keys[i:i + fp.RUN])[1] for i in range(len(keys) - fp.RUN + 1))
    return sorted(i for i, n in points.items() if n >= fp.POINTS) or [min(keys)[1]]


@pytest.fixture(scope="module")
def ranks(documents):
    return fp.rarity_ranks(documents)


def test_features_are_those_of_each_text_alone(documents, ranks):
    texts = [r["text"] for r in documents.limit(30).collect()] + ["", "short", "x" * 64, "y" * 100, "ab" * 400]
    chunk = next(fp.arrays.chunks(pa.array(texts)))
    starts = fp.select_features(chunk, ranks)
    for i in range(len(texts)):
        low, high = chunk.bounds[i], chunk.bounds[i + 1]
        own = starts[(starts >= low) & (starts < high)] - low
        assert own.tolist() == plain_features(chunk.data[low:high], ranks)


def compare(docs, ranks):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows.sort(key=lambda r: -1 << 70 if r[0] is None else r[0], reverse=True)
    got = fp.compared(docs, ranks).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    if len(set(ids)) == len(ids):
        by_id = {r["doc_id"]: r for r in got}
        for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
            r = by_id[doc]
            own, other, changed = fp.fingerprint_filters(pa.array([text, following, edited]), ranks)
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == fp.as_text(own) and r["edited_fingerprint"] == fp.as_text(changed)
            assert r["near_edited"] == fp.likeness(own, changed) and r["near_next"] == fp.likeness(own, other)
    return got


@pytest.mark.parametrize("per_bucket", [7, 4000])
def test_neighbours_across_buckets(documents, ranks, monkeypatch, per_bucket):
    monkeypatch.setattr(fp.with_next, "__defaults__", (per_bucket,))
    got = compare(documents, ranks)
    assert np.median([r["near_edited"] for r in got]) > np.median([r["near_next"] for r in got])
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_odd_rows(odd, clashing, nothing, ranks, spark):
    compare(odd, ranks)
    compare(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), ranks)
    assert len(compare(clashing.drop("lang"), ranks)) == odd.count()
    assert fp.compared(nothing, ranks).count() == 0
    compare(spark.createDataFrame([(5, "a single document, its own next")], "doc_id long, text string"), ranks)
    assert fp.rarity_ranks(nothing).shape == (fp.LEVELS + 1,)


def test_likeness_of_copies_and_strangers(ranks):
    rng = np.random.default_rng(2)
    words = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(600)) for _ in range(2)]
    near = words[0][:2000] + "INSERTED" + words[0][2000:]
    a, b, c, empty = fp.fingerprint_filters(pa.array([words[0], near, words[1], ""]), ranks)
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) > 0.8 and fp.likeness(a, c) < 0.2
    assert fp.likeness(empty, empty) == 1 and fp.likeness(a, empty) == 0
    assert (fp.from_text(fp.as_text(a)) == a).all()
