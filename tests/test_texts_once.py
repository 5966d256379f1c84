"""Labels are cut and compared once, and what a written table has shuffled does not stay."""

import random
import time

from fixtures import reads_df
from pyspark.sql import functions as F
from test_overlaps import dna

from strandweave.operators import string_graph
from strandweave.operators.reduction import transitive_edges, transitive_reduction
from strandweave.plans.assembly import Assembly
from strandweave.session import write_stage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name.rsplit("/", 1)[-1] for name in files.mkString("\n").split("\n") if "shuffle_" in name}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = write_stage(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count(), "counted")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 97
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_digraph_labels_are_cut_from_reads_without_pieces(spark):
    rng = random.Random(11)
    genome = dna(rng, 400)
    run = Assembly(reads_df(spark, [genome[p:p + 60] for p in range(0, 340, 9)]), 20)
    edges = run.digraph.edges
    assert "collect_list" not in edges._jdf.queryExecution().optimizedPlan().toString()
    pieces = string_graph.with_text(run._graph(run.skeleton, run._labels(run.skeleton))).edges
    assert edges.columns == pieces.columns
    assert sorted(edges.collect()) == sorted(pieces.collect()) and edges.count() > 0
    gone = {r.edge_id for r in transitive_edges(edges).collect()}
    assert gone == {r.edge_id for r in transitive_edges(run.skeleton, labels_follow_lengths=True).collect()} and gone


def test_any_path_that_spells_the_label_explains_an_edge(spark):
    # Paths from 0 to 9 over 1, 2 and 3, all of five bases; only the last one spells edge 30. None spells edge 31.
    rows = [(0, 0, 1, "AA"), (1, 1, 9, "CCC"), (2, 0, 2, "AC"), (3, 2, 9, "GGG"), (4, 0, 3, "AC"), (5, 3, 9, "GGT"),
            (30, 0, 9, "ACGGT"), (31, 0, 9, "TTTTT"), (6, 1, 3, "T"), (7, 0, 3, "AAT")]
    edges = spark.createDataFrame(rows, "edge_id long, v1 long, v2 long, seq string")
    assert sorted(r.edge_id for r in transitive_edges(edges).collect()) == [7, 30]
    alone = edges.where("edge_id < 6")
    assert transitive_edges(alone).collect() == []


def test_bidigraph_reduction_writes_its_labels_once(spark):
    rng = random.Random(12)
    genome = dna(rng, 300)
    run = Assembly(reads_df(spark, [genome[p:p + 60] for p in range(0, 240, 11)]), 20)
    graph = string_graph.build_bidigraph(run.kept_reads, run.kept_overlaps)
    plain = string_graph.build_digraph(run.kept_reads, run.kept_overlaps)
    kept = transitive_reduction(graph).edges
    assert "concat(" not in kept._jdf.queryExecution().optimizedPlan().toString()  # compared before, not once more a reader
    want = {r.edge_id >> 1 for r in transitive_reduction(plain).edges.collect()}
    assert {r.edge_id for r in kept.collect()} == want and len(want) < graph.edges.count()
