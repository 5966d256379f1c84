"""Contigs along a cycle: the published one, breaks at special edges, and walks round the start."""

import pytest
from fixtures import TEN_READ_CONTIG, TEN_READS, rc, reads_df

from strandweave.operators import contigs, euler
from strandweave.operators.string_graph import StringGraph
from strandweave.plans import damage
from strandweave.plans.assembly import Assembly

ATTRIBUTES = (1.0, 0, 0.0, 1, False)
SCHEMA = ("edge_id long, v1 long, v2 long, v1_outward boolean, v2_inward boolean, seq12 string, seq21 string, "
          "mapped_read_count double, num_inner_vertices int, a_statistic double, traversal_count int, is_special boolean")


def spelled(pieces):
    out = {}
    for r in pieces.orderBy("contig", "piece").collect():
        out[r["contig"]] = out.get(r["contig"], "") + r["seq"]
    return [out[k] for k in sorted(out)]


def test_published_contig(spark):
    run = Assembly(reads_df(spark, TEN_READS), 15)
    found = spelled(run.contigs)
    assert found and all(c in (TEN_READ_CONTIG, rc(TEN_READ_CONTIG)) for c in found)
    lines = [r["line"] for r in contigs.contig_fasta(run.contigs).orderBy("contig", "piece").collect()]
    assert lines[0] == ">contig_1" and "".join(x for x in lines[1:] if x[0] != ">")[:163] in (TEN_READ_CONTIG, rc(TEN_READ_CONTIG))


def graph_of(spark, special):
    """A ring of four vertices, all left through their ends; edges in ``special`` are special."""
    rows = [(i, i, (i + 1) % 4, True, True, "ACGT"[i] * 2, "TGCA"[i] * 2, *ATTRIBUTES[:4], i in special) for i in range(4)]
    vertices = spark.createDataFrame([(i, False) for i in range(4)], "v long, is_special boolean")
    return StringGraph("bidigraph", vertices, spark.createDataFrame(rows, SCHEMA), 4)


@pytest.mark.parametrize(("special", "want"), [
    ((), ["gAACCGGTT"]), ((0,), ["hCCGGTT"]), ((1, 3), ["gAA", "iGG"]), ((0, 1, 2), ["jTT"]), ((0, 1, 2, 3), []),
])
def test_breaks(spark, special, want):
    graph = graph_of(spark, special)
    cycle = spark.createDataFrame([(0, i, i, True) for i in range(4)], "circuit long, step long, edge_id long, forward boolean")
    reads = spark.createDataFrame([(i, "ghij"[i]) for i in range(4)], "read_id long, seq string")
    assert sorted(spelled(contigs.contig_pieces(graph, cycle, reads))) == sorted(want)


def test_walk_goes_on_round_the_start(spark):
    graph = graph_of(spark, (1,))
    cycle = spark.createDataFrame([(0, i, i, True) for i in range(4)], "circuit long, step long, edge_id long, forward boolean")
    reads = spark.createDataFrame([(i, "ghij"[i]) for i in range(4)], "read_id long, seq string")
    assert spelled(contigs.contig_pieces(graph, cycle, reads)) == ["iGGTTAA"]


def test_backward_walk_starts_with_the_reversed_read(spark):
    graph = graph_of(spark, (0,))
    cycle = spark.createDataFrame([(0, i, 3 - i, False) for i in range(4)], "circuit long, step long, edge_id long, forward boolean")
    reads = spark.createDataFrame([(i, "ACGT"[i]) for i in range(4)], "read_id long, seq string")
    assert spelled(contigs.contig_pieces(graph, cycle, reads)) == [rc("A") + "AA" + "CC" + "GG"]


def test_edge_ids_far_apart_keep_their_darts(spark):
    graph = graph_of(spark, ())
    far = graph.edges.withColumn("edge_id", graph.edges["edge_id"] * (1 << 44) + 5)
    wide = damage.mirrored(graph.with_edges(far))
    cycle = euler.eulerian_cycle(wide)
    assert cycle.count() == 8 and euler.cycle_violations(wide, cycle).isEmpty()
    assert {r["circuit"] for r in cycle.collect()} == {10}
