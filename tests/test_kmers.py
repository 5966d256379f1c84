"""Queries on k-mers: each strand is turned round once a read, and k-mers travel in runs."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from fixtures import rc
from test_overlaps import dna

from strandweave.functions import kmer_runs
from strandweave.operators import overlaps
from strandweave.plans import catalog


def tables_dir(spark, path, reads=40):
    spark.range(100).withColumnRenamed("id", "p_partkey").write.parquet(f"{path}/part.parquet")
    spark.range(reads).withColumnRenamed("id", "event_id").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_sequence_functions_turn_no_single_kmer(spark, tmp_path):
    found = catalog.all_queries()["sequence_functions"](spark, tables_dir(spark, tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(seq" in plan and "translate(lambda" not in plan
    seqs = {r.read_id: r.seq for r in catalog.assembly_of(spark, str(tmp_path)).reads.collect()}
    rows = found.collect()
    assert len(rows) == 40
    for r in rows:
        s = seqs[r.read_id]
        words = [s[i:i + 25] for i in range(len(s) - 24)]
        assert r.rc == rc(s) and r.valid and r.len == len(s)
        assert r.complement == rc(s)[::-1] and r.code_sum == sum("ACGT".index(c) for c in s)
        assert r.canonical == ",".join(min(w, rc(w)) for w in words)
        assert r.reversed_kmers == sum(not w < rc(w) for w in words)


def brute_counts(rows, k):
    found = Counter()
    for i, s in rows:
        for p in range(len(s or "") - k + 1):
            found[min(s[p:p + k], rc(s[p:p + k])), i] += 1
    out = {}
    for (kmer, _), n in found.items():
        a, b = out.get(kmer, (0, 0))
        out[kmer] = (a + n, b + 1)
    return out


@pytest.mark.parametrize("k, crowded", [(4, 100_000), (4, 20), (16, 5), (32, 100_000), (40, 100_000), (40, 3), (70, 4)])
def test_kmers_of_runs_are_counted_by_occurrence_and_read(spark, k, crowded):
    rng = random.Random(k)
    genome = dna(rng, 400) + "A" * 150 + "ACG" * 40 + dna(rng, 60) * 2
    genome += rc(genome[300:500])
    rows = [(i, dna(rng, n)) for i, n in enumerate((1, k - 1, k, k + 1, 200))]
    for i in range(len(rows), 150):
        p = rng.randrange(len(genome))
        s = genome[p:p + rng.randint(60, 140)]
        rows.append((i, rc(s) if rng.random() < 0.5 else s))
    rows += [(7, rows[20][1]), (7, rows[21][1]), (None, rows[22][1]), (None, rows[22][1]), (200, None), (201, ""),
             (202, rows[23][1][:50] + "N" + rows[23][1]), (203, "n" * 90), (8, rows[24][1][:k] + "N" + rows[24][1])]
    table = spark.createDataFrame(rows, "read_id long, seq string").repartition(3)
    got = overlaps.kmer_counts(table, k, crowded).collect()
    want = brute_counts(rows, k)
    assert len(got) == len(want)
    assert {r.kmer: (r.occurrences, r.reads) for r in got} == want


def test_counts_do_not_depend_on_the_chunk():
    rng = random.Random(3)
    seqs = [dna(rng, 100) for _ in range(30)] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(seqs), pa.array([1] * len(seqs))], names=["seq", "n"])
    rows = pa.Table.from_batches(kmer_runs.runs(40, [])([batch])).sort_by("key")
    assert rows.num_rows < len(seqs) * 61 / 5  # runs, not k-mers, travel
    want = None
    for chunk in (1, 300, 1 << 22):
        found = pa.Table.from_batches(kmer_runs.counts(40, chunk)(rows.to_batches(max_chunksize=7))).sort_by("kmer")
        want = want or found
        assert found.equals(want) and found.num_rows == 30 * 61


def test_kmer_counts_shuffle_runs(spark):
    rng = random.Random(5)
    reads = spark.createDataFrame([(i, dna(rng, 100)) for i in range(50)], "read_id long, seq string")
    plan = overlaps.kmer_counts(reads, 40)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan


def test_seed_pairs_are_counted_from_runs(spark):
    rng = random.Random(6)
    genome = dna(rng, 300) + "C" * 60
    rows = [(i, genome[p:p + 90]) for i, p in enumerate(rng.choices(range(270), k=80))] + [(3, genome[:90]), (None, rc(genome[5:99]))]
    found = overlaps.seed_pair_counts(spark.createDataFrame(rows, "read_id long, seq string"), 40)
    assert "hashpartitioning(key" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.kmer: r.pairs for r in found.collect()} == {kmer: n * (n - 1) // 2 for kmer, (n, _) in brute_counts(rows, 40).items()}
