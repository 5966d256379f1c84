"""Window digests against plain arithmetic, and the hot route of the overlap search on long reads."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from fixtures import reads_df
from pyspark.sql import functions as F
from test_overlaps import brute, dna

from strandweave.functions import digests
from strandweave.functions.digests import BASE, PRIME, Digests, batch_prefixes, batch_spans, batch_suffixes
from strandweave.operators import overlaps


def plain(text):
    return sum(ord(c) * pow(BASE, i, PRIME) for i, c in enumerate(text)) % PRIME


def test_products_modulo_the_prime():
    rng = random.Random(1)
    a = [0, 1, PRIME - 1, PRIME - 1, *(rng.randrange(PRIME) for _ in range(500))]
    b = [PRIME - 1, PRIME - 1, PRIME - 1, 2, *(rng.randrange(PRIME) for _ in range(500))]
    got = digests.times(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
    assert got.tolist() == [x * y % PRIME for x, y in zip(a, b, strict=True)]


def test_digests_of_all_windows():
    rng = random.Random(2)
    seqs = ["", "A", dna(rng, 40), dna(rng, 3), "ACGT" * 20, dna(rng, 200)]
    for column in (pa.array(seqs), pa.array(["GATTACA", *seqs]).slice(1)):
        assert batch_prefixes(column).to_pylist() == [[plain(s[:n]) for n in range(1, len(s) + 1)] for s in seqs]
        rows = batch_suffixes(column, 3, 6).to_pylist()
        assert [[r["digest"] for r in own] for own in rows] == [[plain(s[p:]) for p in range(len(s) - 7)] for s in seqs]
        asked = [[(p, n) for p in range(0, len(s), 7) for n in (1, len(s) - p) if p + n <= len(s)] for s in seqs]
        got = batch_spans(column, pa.array([[p for p, _ in x] for x in asked], pa.list_(pa.int32())),
                          pa.array([[n for _, n in x] for x in asked], pa.list_(pa.int32()))).to_pylist()
        assert got == [[plain(s[p:p + n]) for p, n in x] for s, x in zip(seqs, asked, strict=True)]
    assert len(Digests(pa.array([], pa.string())).lens) == 0


@pytest.mark.parametrize("threshold", [1, 3, 512])
def test_rows_do_not_depend_on_the_threshold(spark, threshold):
    rng = random.Random(3)
    adapter, tail = dna(rng, 18), "AC" * 15
    seqs = [adapter + dna(rng, rng.randint(5, 20)) for _ in range(14)] + [adapter] * 2 + [adapter + tail[:k] for k in (4, 9, 30)]
    seqs += [dna(rng, 12) + adapter + tail[:9], tail + adapter, "A" * 40, "A" * 25]
    found = overlaps.compute_overlaps(reads_df(spark, seqs), 12, hot_threshold=threshold)
    assert sorted(tuple(r)[:7] for r in found.collect()) == brute(seqs, 12)


def test_colliding_digests_are_told_apart_by_text(spark, monkeypatch):
    """With a digest that is the same for every window of a length, the text alone decides."""
    rng = random.Random(4)
    adapter = dna(rng, 15)
    seqs = [adapter + dna(rng, 10) for _ in range(6)] + [adapter + dna(rng, 4), dna(rng, 9) + adapter]
    monkeypatch.setattr(overlaps, "prefix_digests", lambda: lambda c: _same(digests.prefix_digests()(c)))
    monkeypatch.setattr(overlaps, "suffix_digests", lambda w, k: lambda c: _same_field(digests.suffix_digests(w, k)(c)))
    monkeypatch.setattr(overlaps, "span_digests", lambda: lambda *c: _same(digests.span_digests()(*c)))
    found = overlaps.compute_overlaps(reads_df(spark, seqs), 10, hot_threshold=1)
    assert sorted(tuple(r)[:7] for r in found.collect()) == brute(seqs, 10)


def _same(column):
    return F.transform(column, lambda x: F.lit(7).cast("long"))


def _same_field(column):
    return F.transform(column, lambda x: F.struct(x["anchor"].alias("anchor"), F.lit(7).cast("long").alias("digest")))


def test_work_is_linear_in_read_length():
    """Ten times the length takes about ten times as long, not a hundred times."""
    rng = random.Random(5)
    short, long = pa.array([dna(rng, 20_000)]), pa.array([dna(rng, 200_000)])

    def seconds(column):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            batch_suffixes(column, 8, 20)
            batch_prefixes(column)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(long) < 40 * seconds(short)
