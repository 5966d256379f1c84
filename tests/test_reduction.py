"""Corner pairs of the reduction: none is lost, and few are carried in vain."""

import random

from fixtures import rc, reads_df
from test_overlaps import dna

from strandweave.operators import reduction
from strandweave.plans.assembly import Assembly
from strandweave.session import cut_lineage


def test_triangles_match_brute_force(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(9), rng.randrange(9), rng.randint(0, 5)) for _ in range(160)})
    table = cut_lineage(spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id long, v1 long, v2 long, len long"))
    got = {tuple(r) for r in reduction._triangles(table).collect()}
    want, possible = set(), 0
    for i, (v, w, p) in enumerate(edges):
        for j, (w2, x, q) in enumerate(edges):
            if w == w2:
                want |= {(i, j, k) for k, e in enumerate(edges) if e == (v, x, p + q)}
                possible += 1
    # A triangle with an edge of no length may be left out: labels are never empty.
    real = {t for t in want if all(edges[k][2] > 0 for k in t)}
    assert real <= got <= want and len(real) > 20
    assert reduction._corner_pairs(table).count() < possible


def test_few_pairs_go_without_a_third_edge(spark):
    """Reads of a genome: at most twice as many pairs are shuffled as there are triangles."""
    rng = random.Random(7)
    genome = dna(rng, 3000)
    starts = [rng.randrange(2920) for _ in range(500)]
    reads = [genome[s:s + rng.randint(60, 80)] for s in starts]
    run = Assembly(reads_df(spark, [rc(r) if rng.random() < 0.5 else r for r in reads]), 30)
    edges = run.skeleton.selectExpr("edge_id", "v1", "v2", "CAST(len AS LONG) AS len")
    pairs, triangles = reduction._corner_pairs(edges).count(), reduction._triangles(edges).count()
    assert 0 < triangles <= pairs <= 2 * triangles


def test_edges_at_corners_are_shuffled_once(spark):
    edges = spark.range(400).selectExpr("id edge_id", "id % 60 v1", "id % 60 + 1 + id div 60 % 2 v2", "1 + id div 60 % 2 len")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        gone = reduction.transitive_edges(edges, labels_follow_lengths=True)
        assert gone.count() > 0
        gone.collect()
        assert "ReusedExchange" in gone._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
