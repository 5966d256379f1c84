"""The block-wise circulation against an independent solver, and its certificate."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import circulation
from strandweave.operators.string_graph import StringGraph
from strandweave.session import cut_lineage
from test_graph import cheapest


def flow_graph(spark, vertices, arcs):
    """``arcs`` are (tail, head, kind): "single" is used once, "long" at least once, "free" as needed."""
    rows = [(k, a, b, 20.0 if kind == "single" else 0.0, 2 if kind == "long" else 0) for k, (a, b, kind) in enumerate(arcs)]
    edges = spark.createDataFrame(rows, "edge_id long, v1 long, v2 long, a_statistic double, num_inner_vertices int")
    edges = edges.selectExpr("edge_id", "edge_id AS twin_id", "v1", "v2", "'A' AS seq", "1.0D AS mapped_read_count",
                             "num_inner_vertices", "a_statistic", "0 AS traversal_count", "false AS is_special")
    points = spark.range(vertices).select(F.col("id").alias("v"), F.lit(False).alias("is_special"))
    return StringGraph("digraph", points, cut_lineage(edges), vertices)


def bounds_of(arcs):
    return [(a, b, 0 if kind == "free" else 1, 1 if kind == "single" else 10**6) for a, b, kind in arcs]


def certified_cost(spark, graph, **how):
    """Cost of the solution, after its prices have proved it."""
    flows, hub = (cut_lineage(x) for x in circulation.solve_circulation(graph, **how))
    slack = circulation.slack_violations(graph.edges, flows.select("edge_id", "flow"), hub)
    assert slack.collect() == []
    proof = circulation.duality(graph.edges, flows.select("edge_id", "flow"), hub).first()
    assert proof["gap"] == 0
    return proof["cost"]


@pytest.mark.parametrize(("seed", "block"), [(3, 50_000), (4, 50_000), (5, 50_000), (3, 6)])
def test_same_optimum_in_one_block_and_in_many(spark, seed, block):
    rng = random.Random(seed)
    n = 14
    arcs = [(rng.randrange(n), rng.randrange(n), rng.choice(["single", "long", "free", "free"])) for _ in range(26)]
    graph = flow_graph(spark, n, arcs)
    assert certified_cost(spark, graph, block_arcs=block) == cheapest(list(range(n)), bounds_of(arcs))


def counted_rounds(monkeypatch, module):
    seen = []
    plain = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(1) or plain(df))
    return seen


def test_a_long_chain_takes_a_fixed_number_of_rounds(spark, monkeypatch):
    """2,000 vertices in line: the surplus of the first must reach the deficit of the last."""
    n = 2000
    order = list(range(n))
    random.Random(8).shuffle(order)
    chain = [(order[k], order[k + 1], "free") for k in range(n - 1)]
    chain += [(order[-1], order[0], "long")]
    rounds = counted_rounds(monkeypatch, circulation)
    assert certified_cost(spark, flow_graph(spark, n, chain)) == n
    assert len(rounds) <= 4


def test_a_chain_longer_than_its_blocks(spark, monkeypatch):
    """Blocks of neighbours: rounds follow the number of block borders, not of hops."""
    n = 600
    chain = [(k, k + 1, "free") for k in range(n - 1)] + [(n - 1, 0, "long")]
    rounds = counted_rounds(monkeypatch, circulation)
    assert certified_cost(spark, flow_graph(spark, n, chain), block_arcs=300) == n
    assert len(rounds) < n // 4


def test_blocks_hold_whole_components_or_neighbours(spark):
    arcs = [(k, k + 1) for k in range(0, 100) if k % 10 != 9] + [(200, 200 + k) for k in range(1, 60)] + [(300 + k, 301 + k) for k in range(50)]
    table = cut_lineage(spark.createDataFrame(arcs, "v1 long, v2 long"))
    vertices = table.select(F.explode(F.array("v1", "v2")).alias("v")).distinct()
    placed = {r["v"]: (r["block"], r["open"]) for r in circulation.blocks(vertices, table, 20).collect()}
    assert len(placed) == vertices.count()
    for a, b in arcs:
        if a < 100:
            assert placed[a] == placed[b] and not placed[a][1]
        else:
            assert placed[a][1] and placed[b][1]
    # Most links of the long path stay inside a block.
    assert sum(placed[a][0] == placed[b][0] for a, b in arcs if a >= 300) >= 30


def test_hub_flow_over_both_hubs(spark):
    """1,500,000 units at one vertex: both hubs carry some, and each is balanced."""
    m = circulation.INFINITE_FLOW
    table = [(0, 1_500_000, 0), (1, 0, 400_000), (2, 0, 900_000), (3, 0, 200_000)]
    hub = spark.createDataFrame(table, "v long, fill long, spill long")
    for swap in (False, True):
        side = hub.select("v", F.col("spill").alias("fill"), F.col("fill").alias("spill")) if swap else hub
        split = circulation.over_two_hubs(side).collect()
        assert sum(r["fill2"] for r in split) == sum(r["spill2"] for r in split) == 500_000
        assert sum(r["fill"] for r in split) == sum(r["spill"] for r in split) == 1_500_000
        for r in split:
            for c in ("fill", "spill"):
                assert 0 <= r[f"{c}2"] <= m and 0 <= r[c] - r[f"{c}2"] <= m
    both = spark.createDataFrame([(0, 1_700_000, 0), (1, 0, 1_700_000)], "v long, fill long, spill long")
    assert {tuple(r) for r in circulation.over_two_hubs(both).collect()} == {
        (0, 1_700_000, 0, 700_000, 0), (1, 0, 1_700_000, 0, 700_000)}
    few = spark.createDataFrame([(0, 5, 0), (1, 0, 5)], "v long, fill long, spill long")
    assert sum(r["fill2"] + r["spill2"] for r in circulation.over_two_hubs(few).collect()) == 0
    with pytest.raises(ValueError):
        circulation.over_two_hubs(spark.createDataFrame([(0, 2 * m + 1, 0)], "v long, fill long, spill long"))


def test_a_vertex_with_a_million_and_a_half_units(spark):
    """As many parallel arcs that must each be used once lead from one vertex to another."""
    n = 1_500_000
    edges = spark.range(n).selectExpr(
        "id AS edge_id", "id AS twin_id", "0L AS v1", "1L AS v2", "'A' AS seq", "1.0D AS mapped_read_count",
        "0 AS num_inner_vertices", "20.0D AS a_statistic", "0 AS traversal_count", "false AS is_special")
    points = spark.range(2).select(F.col("id").alias("v"), F.lit(False).alias("is_special"))
    done = circulation.min_cost_circulation(StringGraph("digraph", points, cut_lineage(edges), 1))
    done = done.with_edges(cut_lineage(done.edges))
    assert circulation.circulation_violations(done).isEmpty()
    special = {(r["v1"], r["v2"]): r["traversal_count"] for r in done.edges.where("is_special AND traversal_count > 0").collect()}
    assert special == {(2, 0): 10**6, (3, 0): 500_000, (1, 2): 10**6, (1, 3): 500_000}


def test_slack_finds_what_is_wrong(spark):
    arcs = [(0, 1, "free"), (1, 2, "long"), (2, 0, "single"), (0, 2, "free")]
    graph = flow_graph(spark, 3, arcs)
    flows, hub = (cut_lineage(x) for x in circulation.solve_circulation(graph))
    worse = flows.withColumn("flow", F.when(F.col("edge_id") == 3, 1).otherwise(F.col("flow")))
    assert {(r["kind"], r["rule"]) for r in circulation.slack_violations(graph.edges, worse, hub).collect()} == {("edge", "used but dear")}
    dear = hub.withColumn("price", F.when(F.col("v") == 1, F.lit(2_000_000)).otherwise(F.col("price")))
    assert {r["rule"] for r in circulation.slack_violations(graph.edges, flows, dear).collect()} >= {"spill is cheaper"}
    assert circulation.duality(graph.edges, worse, hub).first()["gap"] != 0
