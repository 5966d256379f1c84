"""The published worked examples, stage by stage."""

import random

import pytest
from fixtures import (
    TEN_READ_CONTIG,
    TEN_READ_OVERLAPS,
    TEN_READS,
    THREE_READS,
    rc,
    reads_df,
)
from test_overlaps import brute, dna

from strandweave.operators import euler, reduction, render, string_graph
from strandweave.operators.string_graph import to_bidigraph
from strandweave.plans.assembly import Assembly


@pytest.fixture(scope="module")
def ten(spark):
    return Assembly(reads_df(spark, TEN_READS), 15)


def test_overlap_listing(ten):
    lines = [r.line for r in render.print_overlaps(ten.all_overlaps).orderBy("f", "g", "type").collect()]
    assert lines == TEN_READ_OVERLAPS


def test_no_read_contained(ten):
    assert ten.index_map.where("new_id IS NULL").count() == 0


def test_graph_sizes_and_contig(ten):
    assert ten.digraph.edges.count() == 42
    assert ten.reduced.edges.count() == 18
    edges = ten.collapsed.edges.collect()
    assert sorted((e.v1, e.v2, len(e.seq), e.num_inner_vertices) for e in edges) == [(0, 8, 113, 8), (9, 1, 113, 8)]
    label = next(e.seq for e in edges if e.v1 == 9)
    # Read 5 is left through its end; that walk spells the other strand.
    assert rc(TEN_READS[4] + label) == TEN_READ_CONTIG


def test_reduction_agrees_with_and_without_label_text(ten):
    full = reduction.transitive_edges(ten.digraph.edges)
    short = reduction.transitive_edges(ten.skeleton, labels_follow_lengths=True)
    assert sorted(r[0] for r in full.collect()) == sorted(r[0] for r in short.collect())


def test_whole_assembly_ends_in_a_valid_cycle(ten):
    assert euler.balance_violations(ten.bidigraph).isEmpty()
    assert euler.cycle_violations(ten.bidigraph, ten.cycle).isEmpty()
    used = ten.bidigraph.edges.agg({"traversal_count": "sum"}).first()[0]
    assert ten.cycle.count() == used > 0


def test_three_reads(spark):
    run = Assembly(reads_df(spark, THREE_READS), 8)
    rows = [tuple(r)[:7] for r in run.all_overlaps.orderBy("f", "g").collect()]
    assert rows == [
        (0, 0, 19, 1, 12, 31, False), (0, 0, 7, 2, 0, 7, True), (1, 0, 19, 2, 0, 19, True),
    ]
    assert run.skeleton.count() == 6
    assert run.reduced.edges.count() == 4
    assert sorted((len(e.seq), e.num_inner_vertices) for e in run.collapsed.edges.collect()) == [(24, 1), (24, 1)]


def test_reads_at_even_steps(spark):
    """Eleven reads of a random genome, either strand: one path per strand, overlaps as the plain model has them."""
    rng = random.Random(21)
    genome = dna(rng, 430)
    reads = [genome[k:k + 100] for k in range(0, 331, 33)]
    reads = [rc(r) if rng.random() < 0.5 else r for r in reads]
    run = Assembly(reads_df(spark, reads), 25)
    assert sorted(tuple(r)[:7] for r in run.all_overlaps.collect()) == brute(reads, 25)
    assert run.index_map.where("new_id IS NULL").count() == 0
    assert run.skeleton.count() == 2 * len(brute(reads, 25))
    assert run.reduced.edges.count() == 20
    spelled = {e.seq: e.num_inner_vertices for e in run.collapsed.edges.collect()}
    assert spelled == {genome[100:]: 9, rc(genome[:330]): 9}


def test_conversion_round_trip(ten):
    bidi = string_graph.build_bidigraph(ten.kept_reads, ten.kept_overlaps)
    back = string_graph.to_digraph(bidi)
    key = lambda e: (e.v1, e.v2, e.seq)
    assert sorted(map(key, back.edges.collect())) == sorted(map(key, ten.digraph.edges.collect()))
    again = to_bidigraph(back)
    pair = lambda e: (e.v1, e.v2, e.v1_outward, e.v2_inward, e.seq12, e.seq21)
    assert sorted(map(pair, again.edges.collect())) == sorted(map(pair, bidi.edges.collect()))
