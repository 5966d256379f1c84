"""Containments searched on their own, and the reduction of a skeleton by one lookup an edge."""

import random

import pytest
from fixtures import rc, reads_df
from test_overlaps import case_copies, case_repeats, case_tandem, dna, sample

from strandweave.operators import overlaps, reduction, string_graph
from strandweave.operators.containment import f_inside, g_inside, uncontained_overlaps
from strandweave.plans.assembly import Assembly
from strandweave.session import cut_lineage


def rows(df):
    return sorted(tuple(r) for r in df.select(*overlaps.OVERLAP_COLUMNS, "f_len", "g_len").collect())


def case_lengths(rng):
    genome = dna(rng, 250) + "ACG" * 20
    return [r for low, high in ((12, 20), (30, 60), (110, 200)) for r in sample(rng, genome, 18, low, high)], 12


@pytest.mark.parametrize("case", [case_tandem, case_copies, case_lengths], ids=lambda c: c.__name__)
def test_containments_are_those_of_all_overlaps(spark, case):
    seqs, min_len = case(random.Random(13))
    once = {min(s, rc(s)): s for s in seqs}
    reads = reads_df(spark, list(once.values()))
    want = rows(overlaps.compute_overlaps(reads, min_len).where(f_inside() | g_inside()))
    for threshold in (512, 2):
        assert rows(overlaps.containing_overlaps(reads, min_len, hot_threshold=threshold)) == want
    assert want


def test_no_read_is_long_enough(spark):
    found = overlaps.containing_overlaps(reads_df(spark, ["ACGT"]), 12)
    assert found.count() == 0 and "f_len" in found.columns


@pytest.mark.parametrize("case", [case_repeats, case_lengths], ids=lambda c: c.__name__)
def test_assembly_goes_on_from_outer_reads(spark, case):
    """Stages from overlaps between outer reads equal those from all overlaps."""
    seqs, min_len = case(random.Random(17))
    run = Assembly(reads_df(spark, seqs), min_len)
    assert rows(run.kept_overlaps) == rows(uncontained_overlaps(run.distinct_overlaps, run.index_map))
    # Listings alone search contained reads with the rest.
    assert run.overlaps.count() < run.distinct_overlaps.count()


@pytest.mark.parametrize("case", [case_repeats, case_lengths], ids=lambda c: c.__name__)
def test_reduced_skeleton_loses_what_triangles_explain(spark, case):
    seqs, min_len = case(random.Random(1))
    skeleton = cut_lineage(string_graph.edge_skeleton(overlaps.compute_overlaps(reads_df(spark, seqs), min_len)))
    gone = {r["edge_id"] for r in reduction.transitive_edges(skeleton, labels_follow_lengths=True).collect()}
    left = reduction.reduced_skeleton(skeleton)
    assert left.columns == skeleton.columns
    assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in skeleton.collect() if r["edge_id"] not in gone)
    assert gone


def test_corner_pairs_are_listed_for_few_edges_only(spark, monkeypatch):
    """On reads of a genome without repeats lookups settle nearly all; all corner pairs were listed before."""
    rng = random.Random(7)
    genome = dna(rng, 3000)
    starts = [rng.randrange(2920) for _ in range(500)]
    reads = [genome[s:s + rng.randint(60, 80)] for s in starts]
    listed, edges_of = [], reduction.transitive_edges

    def counted(edges, **how):
        listed.append(edges.count())
        return edges_of(edges, **how)

    monkeypatch.setattr(reduction, "transitive_edges", counted)
    run = Assembly(reads_df(spark, [rc(r) if rng.random() < 0.5 else r for r in reads]), 30)
    assert run.reduced_rope.edges.count() * 2 < run.skeleton.count()
    assert sum(listed) * 10 < run.skeleton.count()
