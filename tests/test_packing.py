"""Packed sequences: what travels with the anchors, and the comparison of windows."""

import random

import pyarrow as pa
from fixtures import rc, reads_df
from test_overlaps import dna, sample

from strandweave.functions.packing import pack, windows_equal
from strandweave.operators import overlaps


def test_windows_are_compared_on_either_strand():
    rng = random.Random(21)
    base = [dna(rng, n) for n in (1, 2, 3, 4, 5, 8, 37, 120)] + ["ACGNTACG", "nnnn", "N"]
    rows = []
    for a in base:
        for _ in range(60):
            p = rng.randrange(len(a))
            n = rng.randint(1, len(a) - p)
            a_flip, b_flip = rng.random() < 0.5, rng.random() < 0.5
            strand = rc(a) if a_flip else a
            b = strand[p:p + n] + dna(rng, rng.randrange(4))
            if rng.random() < 0.5:
                k = rng.randrange(n)
                b = b[:k] + rng.choice("ACGT") + b[k + 1:]
            rows.append((a, a_flip, p, rc(b) if b_flip else b, b_flip, n, strand[p:p + n] == b[:n]))
    rng.shuffle(rows)
    a, a_flip, p, b, b_flip, n, want = (list(c) for c in zip(*rows))
    for rest in (slice(None), slice(7, None)):
        columns = [pack(pa.array(a)[rest]), pa.array(a_flip)[rest], pa.array(p)[rest],
                   pack(pa.array(b)[rest]), pa.array(b_flip)[rest], pa.array(n)[rest]]
        assert windows_equal(*columns).to_pylist() == want[rest]
    assert {True, False} == set(want)
    assert len(pack(pa.array([]).cast(pa.string()))) == 0
    assert pack(pa.array(["ACGTACGTA"])).to_pylist() == [bytes([3, 0b00011011, 0b00011011, 0])]


def test_windows_longer_than_a_chunk(monkeypatch):
    from strandweave.functions import packing
    monkeypatch.setattr(packing, "_CHUNK", 16)
    rng = random.Random(4)
    texts = [dna(rng, n) for n in (50, 3, 16, 17, 15, 1, 40)]
    other = [t[:-1] + ("A" if t[-1] != "A" else "C") if k % 2 else t for k, t in enumerate(texts)]
    no, zero, n = pa.array([False] * 7), pa.array([0] * 7), pa.array([len(t) for t in texts])
    same = windows_equal(pack(pa.array(texts)), no, zero, pack(pa.array(other)), no, n)
    assert same.to_pylist() == [k % 2 == 0 for k in range(7)]


def test_no_text_travels(spark):
    """Both sides of the anchor join carry sequences at two bits a base."""
    rng = random.Random(5)
    reads = reads_df(spark, sample(rng, dna(rng, 3000), 60, 80, 120))
    plan = overlaps._met(overlaps._windows(reads, 40), overlaps._starts(reads, 40), 40)._jdf.queryExecution().optimizedPlan()
    found = [plan]
    while found:
        node = found.pop()
        found += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
            assert "string" not in kinds and kinds.count("binary") == 2
            return
    raise AssertionError("no join")
