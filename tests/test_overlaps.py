"""Overlap search against a literal brute-force model, with repeats, copies and hot starts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import rc, reads_df

from strandweave.functions.anchors import batch_anchors
from strandweave.operators import overlaps
from strandweave.operators.overlaps import compute_overlaps, kmer_counts, overlap_violations


def brute(seqs, min_len):
    """Every diagonal of every read pair; the whole common window must match."""
    best = {}
    for i, f in enumerate(seqs):
        for j in range(i, len(seqs)):
            for flip in (False, True):
                g = rc(seqs[j]) if flip else seqs[j]
                for shift in range(-len(g) + 1, len(f)):
                    lo, hi = max(0, shift), min(len(f), shift + len(g))
                    n = hi - lo
                    if n < min_len or f[lo:hi] != g[lo - shift:hi - shift]:
                        continue
                    g_beg = len(g) - (hi - shift) if flip else lo - shift
                    if i == j and (flip or lo == g_beg):
                        if lo == g_beg:
                            continue
                    if i == j and lo > g_beg:
                        continue
                    key = (i, j, lo > 0, flip)
                    rank = (-n, lo, g_beg)
                    if key not in best or rank < best[key]:
                        best[key] = rank
    return sorted(
        (i, lo, lo - neg - 1, j, g_beg, g_beg - neg - 1, flip)
        for (i, j, _, flip), (neg, lo, g_beg) in best.items()
    )


def sample(rng, genome, n, low, high):
    out = []
    for _ in range(n):
        size = rng.randint(low, high)
        at = rng.randrange(len(genome) - size + 1)
        read = genome[at:at + size]
        out.append(rc(read) if rng.random() < 0.5 else read)
    return out


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def case_random(rng):
    return sample(rng, dna(rng, 300), 40, 30, 50), 12


def case_repeats(rng):
    unit = dna(rng, 40)
    genome = dna(rng, 80) + unit + dna(rng, 60) + unit + dna(rng, 60) + rc(unit) + dna(rng, 80)
    return sample(rng, genome, 45, 25, 45), 10


def case_tandem(rng):
    genome = dna(rng, 60) + "AC" * 30 + dna(rng, 60) + "A" * 30
    return sample(rng, genome, 40, 20, 35), 9


def case_copies(rng):
    reads = sample(rng, dna(rng, 150), 12, 30, 45)
    same = reads[0]
    return reads + [same] * 5 + [rc(same)] * 4 + ["ACGT" * 8, same[:20], "ACG"], 12


def case_adapter(rng):
    adapter = dna(rng, 20)
    return [adapter + dna(rng, rng.randint(15, 30)) for _ in range(25)] + sample(rng, dna(rng, 100), 10, 25, 40), 14


CASES = [case_random, case_repeats, case_tandem, case_copies, case_adapter]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c.__name__)
def test_matches_brute_force(spark, case):
    seqs, min_len = case(random.Random(7))
    reads = reads_df(spark, seqs)
    want = brute(seqs, min_len)
    cold = compute_overlaps(reads, min_len)
    assert sorted(tuple(r)[:7] for r in cold.collect()) == want
    hot = compute_overlaps(reads, min_len, hot_threshold=2)
    assert sorted(tuple(r)[:7] for r in hot.collect()) == want
    assert overlap_violations(reads, cold, min_len).isEmpty()


@pytest.mark.parametrize("case", [case_tandem, case_copies], ids=lambda c: c.__name__)
def test_overlaps_of_some_reads(spark, case):
    seqs, min_len = case(random.Random(11))
    some = set(range(0, len(seqs), 3))
    touching = spark.createDataFrame([(i,) for i in some] * 2, "read_id long")
    want = [o for o in brute(seqs, min_len) if o[0] in some or o[3] in some]
    for threshold in (512, 2):
        got = compute_overlaps(reads_df(spark, seqs), min_len, hot_threshold=threshold, touching=touching)
        assert sorted(tuple(r)[:7] for r in got.collect()) == want


def test_rows_of_one_strand_travel(spark):
    """Windows of forward strands are all that is shuffled, and few per read; windows are merged without a sort."""
    rng = random.Random(5)
    reads = reads_df(spark, sample(rng, dna(rng, 3000), 200, 80, 120))
    windows = overlaps._windows(reads, 40)
    assert windows.where("a_flip").isEmpty()
    assert windows.count() < 200 * 9
    plan = compute_overlaps(reads, 40)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_lengths_around_the_minimum(spark):
    rng = random.Random(3)
    mid = dna(rng, 20)
    seqs = [dna(rng, 15) + mid, mid + dna(rng, 15)]
    reads = reads_df(spark, seqs)
    assert compute_overlaps(reads, 20).count() == len(brute(seqs, 20)) >= 1
    longest = max(o[2] - o[1] + 1 for o in brute(seqs, 1))
    assert compute_overlaps(reads, longest + 1).count() == 0


def test_inexact_overlaps_are_refused(spark):
    with pytest.raises(NotImplementedError):
        compute_overlaps(reads_df(spark, ["ACGT"]), 4, max_edits=1)


def test_broken_overlaps_are_reported(spark):
    reads = reads_df(spark, ["AAAACCCCGG", "CCCCGGTTTT"])
    rows = [(0, 4, 9, 1, 0, 5, False), (0, 3, 8, 1, 0, 5, False), (0, 4, 9, 1, 0, 4, False),
            (0, 8, 12, 1, 0, 4, False), (0, 0, 0, 1, 0, 0, False)]
    bad = spark.createDataFrame(rows, "f long, f_beg int, f_end int, g long, g_beg int, g_end int, rc boolean")
    rules = sorted(r.rule for r in overlap_violations(reads, bad, 5).collect())
    assert rules == ["lengths", "mismatch", "range", "too short"]


@pytest.mark.parametrize("w,k", [(1, 1), (3, 6), (9, 17), (14, 27), (32, 40)])
def test_anchor_kernel(w, k):
    rng = random.Random(w * 100 + k)
    seqs = [dna(rng, n) for n in (0, 1, w + k - 2, w + k - 1, w + k, 100, 150)] + ["AC" * 60]
    per_window = batch_anchors(pa.array(seqs), w, k, distinct=False).to_pylist()
    distinct = batch_anchors(pa.array(seqs), w, k).to_pylist()
    codes = {}
    for seq, rows, short in zip(seqs, per_window, distinct):
        assert len(rows) == max(0, len(seq) - w - k + 2)
        for at, row in enumerate(rows):
            window = {}
            assert at <= row["pos"] < at + w
            word = seq[row["pos"]:row["pos"] + k]
            assert codes.setdefault(word, row["hash"]) == row["hash"]
            window[seq[at:at + w + k - 1]] = row["pos"] - at
        kept = []
        for row in rows:
            if not kept or kept[-1] != row:
                kept.append(row)
        assert short == kept
    assert len(set(codes.values())) == len(codes)
    sliced = batch_anchors(pa.array(seqs).slice(2), w, k).to_pylist()
    assert sliced == distinct[2:]
    assert isinstance(np.int64(1), np.integer)


def test_kmer_counts_merge_strands(spark):
    got = {r.kmer: (r.occurrences, r.reads) for r in kmer_counts(reads_df(spark, ["AACC", "GGTT", "AACCAACC"]), 4).collect()}
    assert got["AACC"] == (4, 3)
