"""Minimum-cost circulation that assigns a traversal count to every edge.

The graph gains two hubs that every vertex can reach and be reached from at a prohibitive
cost. Equivalently, each vertex may *fill* (hub to vertex) or *spill* (vertex to hub).

The solver repeats two steps:

1. every vertex learns the cheapest residual route for one unit of its surplus, to a filled vertex
   (whose fill it cancels) or to the hub;
2. all surplus moves along those routes, limited by residual capacity.

Starting from the lower bounds, with every deficit filled, the flow is optimal for its own
imbalance; units that move along cheapest routes keep it so. When no surplus is left, it
is the optimal circulation, and the route costs are the dual prices that prove it.

Vertices are dealt into *blocks* of bounded size. Inside a block a step runs to its end in one task;
between blocks prices and surplus travel by joins, one written table per round. A
component that fits into a block is solved in a single round, whatever its shape; one that does not
is cut into clusters of neighbours, so that rounds count block borders and not hops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.residual import UNIT_COST, Block, settle, solve
from strandweave.operators.copy_number import SINGLE_COPY_THRESHOLD
from strandweave.operators.degrees import components
from strandweave.operators.ranking import running_total
from strandweave.operators.string_graph import StringGraph
from strandweave.session import cut_lineage

# Fixed values of the flow model.
INFINITE_FLOW = 1_000_000
HUGE_COST = 1_000_000

# Arcs that one task holds at a time, about.
BLOCK_ARCS = 50_000
_MERGE_ROUNDS = 24

_STATE = "row int, id long, surplus long, fill long, spill long, price long, via long, via_forward boolean, changed boolean"


def flow_bounds(edges: DataFrame) -> DataFrame:
    """``(edge_id, lower, upper, cost)`` of every edge.

    Single-copy edges are used exactly once, other edges that stand for reads at least once,
    the rest freely; special edges are free but dear.
    """
    special, single = F.col("is_special"), F.col("a_statistic") >= SINGLE_COPY_THRESHOLD
    return edges.select(
        "edge_id",
        F.when(special, 0).when(single, 1).when(F.col("num_inner_vertices") > 0, 1).otherwise(0).alias("lower"),
        F.when(~special & single, 1).otherwise(INFINITE_FLOW).alias("upper"),
        F.when(special, HUGE_COST).otherwise(UNIT_COST).alias("cost"),
    )


def _initial_nodes(graph: StringGraph, arcs: DataFrame) -> DataFrame:
    ends = arcs.where(F.col("flow") > 0).select(F.explode(F.array(
        F.struct(F.col("v2").alias("v"), F.col("flow").alias("x")),
        F.struct(F.col("v1").alias("v"), (-F.col("flow")).alias("x")),
    )).alias("e")).select("e.*")
    zero = graph.vertices.select("v", F.lit(0).cast("long").alias("x"))
    net = F.sum("x")
    return ends.unionByName(zero).groupBy("v").agg(
        F.greatest(net, F.lit(0)).alias("surplus"),
        F.greatest(-net, F.lit(0)).alias("fill"),
    ).withColumn("spill", F.lit(0).cast("long"))


def blocks(vertices: DataFrame, arcs: DataFrame, size: int) -> DataFrame:
    """``(v, block, open)``: blocks of about ``size`` arcs; ``open`` where arcs may leave the block.

    Few arcs are one block. Otherwise whole components share blocks, and only components
    larger than a block are clustered: clusters pair up with a neighbour round by
    round, so that a block is made of connected pieces. Pairing needs one grouped minimum
    per side, however crowded a vertex.
    """
    total = arcs.count()
    if total <= size:
        return vertices.select("v", F.lit(0).alias("block"), F.lit(False).alias("open"))
    number = -(-total // size)
    label = cut_lineage(components(vertices, arcs.select("v1", "v2")))
    weight = arcs.groupBy(F.col("v1").alias("v")).count().join(label, "v").groupBy("component").agg(F.sum("count").alias("arcs"))
    placed = cut_lineage(label.join(weight, "component", "left").select(
        "v", "component", (F.coalesce("arcs", F.lit(0)) > size).alias("open")))
    whole = placed.where(~F.col("open")).select("v", F.pmod(F.xxhash64("component"), F.lit(number)).cast("int").alias("block"), "open")
    # A vertex weighs as much as its arcs, so a crowded one stays alone and its arcs go over borders.
    degree = arcs.select(F.explode(F.array("v1", "v2")).alias("v")).groupBy("v").count()
    cluster = placed.where("open").join(degree, "v").select("v", F.col("v").alias("cluster"), F.col("count").alias("held"))
    if cluster.isEmpty():
        return whole
    for k in range(_MERGE_ROUNDS):
        cluster = cut_lineage(cluster)
        one, other = (cluster.select(F.col("v").alias(f"v{i}"), F.col("cluster").alias(f"c{i}"), F.col("held").alias(f"n{i}")) for i in (1, 2))
        meet = arcs.select("v1", "v2").join(one, "v1").join(other, "v2").where(
            (F.col("c1") != F.col("c2")) & (F.col("n1") + F.col("n2") <= size))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
        sides = meet.select(F.explode(F.array(
            F.struct(F.col("c1").alias("leads"), F.col("c2").alias("joins"), F.col("n2").alias("more")),
            F.struct(F.col("c2").alias("leads"), F.col("c1").alias("joins"), F.col("n1").alias("more")),
        )).alias("s")).select("s.*").where(coin("leads") & ~coin("joins"))
        chosen = sides.groupBy("leads").agg(F.min(F.struct("more", "joins")).alias("m")).select("leads", "m.*")
        pairs = cut_lineage(chosen.groupBy("joins").agg(F.min("leads").alias("leads"), F.first("more").alias("more")))
        if pairs.isEmpty() and k > 6:
            break
        grown = pairs.select(F.col("leads").alias("cluster"), F.col("more"))
        cluster = (
            cluster.join(pairs.select(F.col("joins").alias("cluster"), "leads"), "cluster", "left")
            .select("v", F.coalesce("leads", "cluster").alias("cluster"))
            .join(cluster.select(F.col("v").alias("cluster"), F.col("held").alias("own")), "cluster")
            .join(grown, "cluster", "left")
            .select("v", "cluster", (F.col("own") + F.coalesce("more", F.lit(0))).alias("held"))
        )
    cut = cluster.select("v", F.pmod(F.xxhash64("cluster"), F.lit(number)).cast("int").alias("block"), F.lit(True).alias("open"))
    return cut_lineage(whole.unionByName(cut))


class _Task:
    """One block's rows as arrays."""

    def __init__(self, nodes: pd.DataFrame, arcs: pd.DataFrame):
        self.v = nodes["v"].to_numpy(np.int64)
        order = np.argsort(self.v, kind="stable")
        nodes = nodes.iloc[order]
        self.v = self.v[order]
        self.surplus, self.fill, self.spill, self.price = (
            nodes[c].to_numpy(np.int64).copy() for c in ("surplus", "fill", "spill", "price"))
        arcs = arcs.sort_values("edge_id")
        self.arc = arcs["edge_id"].to_numpy(np.int64)
        tail, head = (np.searchsorted(self.v, arcs[c].to_numpy(np.int64)) for c in ("v1", "v2"))
        lower, upper, flow = (arcs[c].to_numpy(np.int64) for c in ("lower", "upper", "flow"))
        self.block = Block(len(self.v), tail, head, lower, upper, flow)
        # ``via`` is an edge, or -1 for the hub; a route that leaves the block is no inner direction.
        self.outer, self.outer_back = nodes["via"].to_numpy(np.int64).copy(), ~nodes["via_forward"].to_numpy(bool)
        place = np.searchsorted(self.arc, self.outer)
        place[place == len(self.arc)] = 0
        inner = (self.outer >= 0) & (self.arc[place] == self.outer) if len(self.arc) else np.zeros(len(self.v), dtype=bool)
        self.via = np.where(inner, place * 2 + self.outer_back, -1)

    @property
    def at_hub(self) -> np.ndarray:
        return (self.via < 0) & (self.outer < 0)

    def rows(self, changed: np.ndarray, arcs: bool = True) -> pd.DataFrame:
        inside = self.via >= 0
        edge, back = self.outer.copy(), self.outer_back.copy()
        edge[inside], back[inside] = self.arc[self.via[inside] >> 1], self.via[inside] & 1
        nodes = pd.DataFrame({"row": 0, "id": self.v, "surplus": self.surplus, "fill": self.fill, "spill": self.spill,
                              "price": self.price, "via": edge, "via_forward": ~back, "changed": changed})
        if not arcs:
            return nodes
        flows = pd.DataFrame({"row": 1, "id": self.arc, "surplus": self.block.flow, "fill": 0, "spill": 0,
                              "price": 0, "via": -1, "via_forward": True, "changed": False})
        return pd.concat([nodes, flows])


def _solve_task(key: tuple, nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    task = _Task(nodes, arcs)
    task.outer[:] = -1
    task.price, task.via = solve(task.block, task.surplus, task.fill, task.spill, HUGE_COST)
    return task.rows(np.zeros(len(task.v), dtype=bool))


def _route_task(key: tuple, nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    task = _Task(nodes, arcs)
    fresh = nodes.set_index("v")["fresh"].reindex(task.v).to_numpy(bool)
    changed = task.block.relax(task.price, task.via, fresh)
    return task.rows(changed | fresh, arcs=False)


def _push_task(key: tuple, nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    task = _Task(nodes, arcs)
    before = task.surplus.copy()
    moved = False
    progress = True
    while progress:
        progress = task.block.push(task.surplus, task.via)
        progress |= settle(task.surplus, task.fill, task.spill, task.price, task.at_hub)
        moved |= progress
    return task.rows((task.surplus != before) | moved)


def _in_blocks(nodes: DataFrame, arcs: DataFrame, work) -> DataFrame:
    """``work`` on every block's nodes and inner arcs, written."""
    inner = arcs.where(F.col("b1") == F.col("b2")).select("edge_id", "v1", "v2", "lower", "upper", "flow", F.col("b1").alias("block"))
    done = nodes.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(work, _STATE)
    return cut_lineage(done)


_NODE = ("v", "block", "surplus", "fill", "spill", "price", "via", "via_forward")
_ARC = ("edge_id", "v1", "v2", "b1", "b2", "lower", "upper")


def _nodes_of(done: DataFrame, placed: DataFrame) -> DataFrame:
    found = done.where(F.col("row") == 0).withColumnRenamed("id", "v").drop("row")
    return found.join(placed.select("v", "block"), "v")


def _flows_of(done: DataFrame, arcs: DataFrame) -> DataFrame:
    found = done.where(F.col("row") == 1).select(F.col("id").alias("edge_id"), F.col("surplus").alias("inner_flow"))
    return arcs.join(found, "edge_id", "left").select(*_ARC, F.coalesce("inner_flow", "flow").alias("flow"))


def _crossing(arcs: DataFrame) -> DataFrame:
    """``(u, w, cost, room, edge_id, forward)``: both directions, with room, of arcs between blocks."""
    both = F.array(
        F.struct(F.col("v1").alias("u"), F.col("v2").alias("w"), F.lit(UNIT_COST).alias("cost"),
                 (F.col("upper") - F.col("flow")).alias("room"), F.lit(True).alias("forward")),
        F.struct(F.col("v2").alias("u"), F.col("v1").alias("w"), F.lit(-UNIT_COST).alias("cost"),
                 (F.col("flow") - F.col("lower")).alias("room"), F.lit(False).alias("forward")),
    )
    cross = arcs.where(F.col("b1") != F.col("b2"))
    return cross.select("edge_id", F.explode(both).alias("r")).select("edge_id", "r.*").where(F.col("room") > 0)


def _routes(nodes: DataFrame, arcs: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes with the cost ``price`` of their cheapest route and its first arc ``via``, block by block.

    ``via`` is -1 where the route goes straight to the hub. Only changed prices are offered over
    the borders of blocks.
    """
    start = nodes.select("v", "block", "surplus", "fill", "spill",
                         F.when(F.col("fill") > 0, -HUGE_COST).otherwise(HUGE_COST).cast("long").alias("price"),
                         F.lit(-1).cast("long").alias("via"), F.lit(True).alias("via_forward"), F.lit(True).alias("fresh"))
    crossing = cut_lineage(_crossing(arcs))
    while True:
        done = _in_blocks(start, arcs, _route_task)
        routed = _nodes_of(done, placed)
        offers = (
            crossing.join(routed.where("changed").select(F.col("v").alias("w"), "price"), "w")
            .groupBy(F.col("u").alias("v"))
            .agg(F.min(F.struct((F.col("price") + F.col("cost")).alias("price"), "edge_id", "forward")).alias("o"))
        )
        better = F.coalesce(F.col("o.price") < F.col("price"), F.lit(False))
        start = cut_lineage(routed.join(offers, "v", "left").select(
            "v", "block", "surplus", "fill", "spill",
            F.when(better, F.col("o.price")).otherwise(F.col("price")).alias("price"),
            F.when(better, F.col("o.edge_id")).otherwise(F.col("via")).alias("via"),
            F.when(better, F.col("o.forward")).otherwise(F.col("via_forward")).alias("via_forward"),
            better.alias("fresh"),
        ))
        if start.where("fresh").isEmpty():
            return start.drop("fresh")


def _move(nodes: DataFrame, arcs: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """One round: surplus moves through its block, then over the border its route leads to."""
    done = _in_blocks(nodes, arcs, _push_task)
    moved_inside = not done.where((F.col("row") == 0) & F.col("changed")).isEmpty()
    nodes, arcs = _nodes_of(done, placed), _flows_of(done, arcs)
    sent = cut_lineage(
        nodes.where((F.col("surplus") > 0) & (F.col("via") >= 0))
        .select(F.col("v").alias("u"), "surplus", F.col("via").alias("edge_id"), F.col("via_forward").alias("forward"))
        .join(_crossing(arcs), ["u", "edge_id", "forward"])
        .select("edge_id", "forward", "u", "w", F.least("surplus", "room").alias("amount"))
    )
    delta = sent.groupBy("edge_id").agg(F.sum(F.when(F.col("forward"), F.col("amount")).otherwise(-F.col("amount"))).alias("delta"))
    arcs = cut_lineage(arcs.join(delta, "edge_id", "left").select(*_ARC, (F.col("flow") + F.coalesce("delta", F.lit(0))).alias("flow")))
    net = sent.select(F.explode(F.array(
        F.struct(F.col("w").alias("v"), F.col("amount").alias("x")),
        F.struct(F.col("u").alias("v"), (-F.col("amount")).alias("x")),
    )).alias("e")).select("e.*").groupBy("v").agg(F.sum("x").alias("net"))
    after = cut_lineage(nodes.join(net, "v", "left").withColumn("surplus", F.col("surplus") + F.coalesce("net", F.lit(0))).select(*_NODE))
    return after, arcs, moved_inside or not sent.isEmpty()


def solve_circulation(graph: StringGraph, block_arcs: int = BLOCK_ARCS) -> tuple[DataFrame, DataFrame]:
    """``(edge_id, lower, upper, flow)`` and ``(v, fill, spill, price)`` of an optimal circulation.

    ``price`` is the cost of the cheapest residual route from v to the hub: no residual
    arc u -> w has ``cost + price(w) < price(u)``.
    """
    bounds = flow_bounds(graph.edges)
    regular = cut_lineage(
        graph.edges.where(~F.col("is_special")).select("edge_id", "v1", "v2")
        .join(bounds.select("edge_id", "lower", "upper"), "edge_id")
        .select("edge_id", "v1", "v2", "lower", "upper", F.col("lower").cast("long").alias("flow"))
    )
    placed = blocks(graph.vertices, regular, block_arcs)
    arcs = (
        regular.join(placed.select(F.col("v").alias("v1"), F.col("block").alias("b1")), "v1")
        .join(placed.select(F.col("v").alias("v2"), F.col("block").alias("b2"), "open"), "v2")
    )
    nodes = _initial_nodes(graph, regular).join(placed, "v").select(
        "v", "block", "open", "surplus", "fill", "spill", F.lit(0).cast("long").alias("price"),
        F.lit(-1).cast("long").alias("via"), F.lit(True).alias("via_forward"))
    closed_arcs = arcs.where(~F.col("open"))
    done = _in_blocks(nodes.where(~F.col("open")), closed_arcs, _solve_task)
    flows = _flows_of(done, closed_arcs.select(*_ARC, "flow"))
    settled = done.where(F.col("row") == 0).select(F.col("id").alias("v"), "fill", "spill", "price")
    # Without open vertices the rest is an empty table; its size is known only to Spark.
    if not placed.where("open").isEmpty():
        arcs = cut_lineage(arcs.where("open").select(*_ARC, "flow"))
        nodes = cut_lineage(nodes.where("open").select(*_NODE))
        while True:
            nodes = _routes(nodes, arcs, placed)
            if nodes.where(F.col("surplus") > 0).isEmpty():
                break
            progress = True
            while progress:
                nodes, arcs, progress = _move(nodes, arcs, placed)
        flows = flows.unionByName(arcs)
        settled = settled.unionByName(nodes.select("v", "fill", "spill", "price"))
    return flows.select("edge_id", "lower", "upper", "flow"), settled


def over_two_hubs(hub: DataFrame) -> DataFrame:
    """``(v, fill, spill, fill2, spill2)``: what of each vertex's hub flow the second hub carries.

    That is what exceeds the bound of one edge. The second hub must be balanced too: where vertices exceed it on
    one side only, as much of the other side is passed to the second hub, from the lowest vertices on.
    """
    beyond = lambda c: F.greatest(F.col(c) - INFINITE_FLOW, F.lit(0))
    top = hub.agg(F.max(F.greatest("fill", "spill")).alias("most"),
                  *[F.sum(beyond(c)).alias(c) for c in ("fill", "spill")]).first()
    if (top["most"] or 0) > 2 * INFINITE_FLOW:
        raise ValueError("no circulation stays within the flow bounds")
    split = hub.withColumn("fill2", beyond("fill")).withColumn("spill2", beyond("spill"))
    short = (top["fill"] or 0) - (top["spill"] or 0)
    if short == 0:
        return split
    side = "spill" if short > 0 else "fill"
    room = F.least(F.col(side), F.lit(INFINITE_FLOW)) - F.col(f"{side}2")
    split = running_total(split.withColumn("room", room), "v", "room", "before")
    extra = F.greatest(F.lit(0), F.least(F.col("room"), F.lit(abs(short)) - F.col("before")))
    return split.withColumn(f"{side}2", F.col(f"{side}2") + extra).drop("room", "before")


def min_cost_circulation(graph: StringGraph) -> StringGraph:
    """Graph with the hubs and optimal traversal counts; see ``with_flows``."""
    if graph.kind != "digraph":
        raise ValueError("the circulation is computed on a directed graph")
    return with_flows(graph, *(cut_lineage(x) for x in solve_circulation(graph)))


def with_flows(graph: StringGraph, flows: DataFrame, solved: DataFrame) -> StringGraph:
    """Graph with hub vertices n and n + 1, special edges, and the traversal counts of a solution.

    n is twice the number of reads the graph was built from. Every vertex has special
    edges to and from both hub vertices; see ``over_two_hubs`` for how they share the hub flow.
    """
    if graph.kind != "digraph":
        raise ValueError("the circulation is computed on a directed graph")
    hub = over_two_hubs(solved)
    label = F.lit("").alias("seq") if graph.pieces is None else F.lit(0).cast("long").alias("len")
    n = graph.orig_num_reads * 2
    top = graph.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0] + 1
    v, mirror = F.col("v"), F.col("v").bitwiseXOR(F.lit(1))

    def special(slot: int, twin_slot: int, tail, head, flow):
        return F.struct(
            (F.lit(top) + v * 4 + slot).alias("edge_id"),
            (F.lit(top) + mirror * 4 + twin_slot).alias("twin_id"),
            tail.cast("long").alias("v1"), head.cast("long").alias("v2"),
            flow.cast("int").alias("traversal_count"),
        )

    first, second = F.lit(n), F.lit(n + 1)
    hub_edges = hub.select(F.explode(F.array(
        special(0, 3, v, first, F.col("spill") - F.col("spill2")),
        special(1, 2, first, v, F.col("fill") - F.col("fill2")),
        special(2, 1, v, second, F.col("spill2")),
        special(3, 0, second, v, F.col("fill2")),
    )).alias("e")).select(
        "e.edge_id", "e.twin_id", "e.v1", "e.v2", label,
        F.lit(1.0).alias("mapped_read_count"), F.lit(0).alias("num_inner_vertices"),
        F.lit(0.0).alias("a_statistic"), "e.traversal_count", F.lit(True).alias("is_special"),
    )
    regular = graph.edges.drop("traversal_count").join(
        flows.select("edge_id", F.col("flow").cast("int").alias("traversal_count")), "edge_id"
    ).select(*hub_edges.columns)
    spark = graph.edges.sparkSession
    hubs = spark.range(n, n + 2).select(F.col("id").alias("v"), F.lit(True).alias("is_special"))
    return graph.with_edges(regular.unionByName(hub_edges), graph.vertices.unionByName(hubs))


def circulation_cost(graph: StringGraph) -> DataFrame:
    """One row: edges used, units of flow and total cost."""
    return graph.edges.join(flow_bounds(graph.edges).select("edge_id", "cost"), "edge_id").agg(
        F.count_if(F.col("traversal_count") > 0).alias("edges_used"),
        F.coalesce(F.sum("traversal_count"), F.lit(0)).alias("flow"),
        F.coalesce(F.sum(F.col("traversal_count").cast("long") * F.col("cost")), F.lit(0)).alias("total_cost"),
    )


def circulation_violations(graph: StringGraph) -> DataFrame:
    """``(kind, id)`` for edges outside their bounds and vertices out of balance."""
    bounded = graph.edges.select("edge_id", "traversal_count").join(flow_bounds(graph.edges), "edge_id")
    outside = bounded.where(
        (F.col("traversal_count") < F.col("lower")) | (F.col("traversal_count") > F.col("upper"))
    ).select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    ends = graph.edges.where(F.col("traversal_count") != 0).select(F.explode(F.array(
        F.struct(F.col("v2").alias("v"), F.col("traversal_count").cast("long").alias("x")),
        F.struct(F.col("v1").alias("v"), (-F.col("traversal_count").cast("long")).alias("x")),
    )).alias("e")).select("e.*")
    uneven = ends.groupBy("v").agg(F.sum("x").alias("net")).where(F.col("net") != 0).select(
        F.lit("vertex").alias("kind"), F.col("v").alias("id")
    )
    return outside.unionByName(uneven)


def slack_violations(edges: DataFrame, flows: DataFrame, hub: DataFrame) -> DataFrame:
    """``(kind, id, rule, reduced_cost)``: where a flow and prices break complementary slackness.

    An edge u -> w costs ``1 + price(w) - price(u)`` after prices: it may hold room only if that is not
    negative and be used beyond its lower bound only if it is not positive. A vertex may send to the hub at the hub
    cost and be filled by it at the same cost; it does either only at exactly that price. No rows
    prove that the flow is a cheapest one.
    """
    price = hub.select("v", "price")
    arc = (
        edges.where(~F.col("is_special")).select("edge_id", "v1", "v2")
        .join(flow_bounds(edges).select("edge_id", "lower", "upper"), "edge_id").join(flows.select("edge_id", "flow"), "edge_id")
        .join(price.select(F.col("v").alias("v1"), F.col("price").alias("p1")), "v1")
        .join(price.select(F.col("v").alias("v2"), F.col("price").alias("p2")), "v2")
        .withColumn("reduced_cost", UNIT_COST + F.col("p2") - F.col("p1"))
    )
    edge_rule = F.when((F.col("flow") < F.col("upper")) & (F.col("reduced_cost") < 0), "cheap but not full").when(
        (F.col("flow") > F.col("lower")) & (F.col("reduced_cost") > 0), "used but dear")
    p, limit = F.col("price"), F.lit(HUGE_COST)
    hub_rule = (
        F.when(p > limit, "spill is cheaper").when(p < -limit, "fill is cheaper")
        .when((F.col("spill") > 0) & (p < limit), "spilled too early").when((F.col("fill") > 0) & (p > -limit), "filled too early"))
    return (
        arc.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), edge_rule.alias("rule"), "reduced_cost")
        .unionByName(hub.select(F.lit("vertex").alias("kind"), F.col("v").alias("id"), hub_rule.alias("rule"),
                                p.cast("long").alias("reduced_cost")))
        .where(F.col("rule").isNotNull())
    )


def duality(edges: DataFrame, flows: DataFrame, hub: DataFrame) -> DataFrame:
    """One row ``(cost, bound, gap)``: cost of a flow and the lower bound that its prices prove.

    Every unit of an edge's lower bound costs at least its reduced cost, and each of its capacity
    saves at most as much as that is negative; prices of vertices cancel out around every circulation.
    """
    arc = (
        edges.where(~F.col("is_special")).select("edge_id", "v1", "v2")
        .join(flow_bounds(edges).select("edge_id", "lower", "upper"), "edge_id").join(flows.select("edge_id", "flow"), "edge_id")
        .join(hub.select(F.col("v").alias("v1"), F.col("price").alias("p1")), "v1")
        .join(hub.select(F.col("v").alias("v2"), F.col("price").alias("p2")), "v2")
    )
    wide = "decimal(38,0)"
    reduced = (UNIT_COST + F.col("p2") - F.col("p1")).cast(wide)
    on_edges = arc.select(
        (F.col("flow").cast(wide) * UNIT_COST).alias("cost"),
        F.when(reduced > 0, reduced * F.col("lower")).otherwise(reduced * F.col("upper")).cast(wide).alias("bound"))
    # Hub edges carry up to twice the bound of one: two hubs.
    room = F.lit(2 * INFINITE_FLOW).cast(wide)
    out = (F.lit(HUGE_COST) - F.col("price")).cast(wide)
    into = (F.lit(HUGE_COST) + F.col("price")).cast(wide)
    at_hub = hub.select(
        ((F.col("fill") + F.col("spill")).cast(wide) * HUGE_COST).cast(wide).alias("cost"),
        (F.least(out, F.lit(0)) * room + F.least(into, F.lit(0)) * room).cast(wide).alias("bound"))
    return on_edges.unionByName(at_hub).agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("cost"), F.coalesce(F.sum("bound"), F.lit(0)).cast("long").alias("bound"),
    ).withColumn("gap", F.col("cost") - F.col("bound"))
