"""Generalized Eulerian cycles of a bidirected graph.

Every edge is used ``traversal_count`` times, in either direction; a vertex entered
through an inward head is left through an outward one and vice versa. One closed walk
results per connected component of used edges.

No task walks the graph. Each use of an edge has two ends (*darts*). Matching inward with
outward darts at each vertex splits the uses into closed circuits at once; circuits
that meet at a vertex are then merged by exchanging partners there, many at a time;
finally pointer doubling numbers the steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.degrees import components
from strandweave.operators.pointers import LOCAL_ROWS, follow, in_one_task, join_by_key
from strandweave.operators.ranking import dense_order, group_ranks
from strandweave.operators.string_graph import StringGraph
from strandweave.session import cut_lineage

# A dart id packs the number of the edge among the used ones, the use and the end.
USE_BITS = 22
MOST_USES = 1 << USE_BITS
MOST_EDGES = 1 << (62 - USE_BITS)


def _use(dart: Column) -> Column:
    return F.shiftright(dart, 1)


def _edge(dart: Column) -> Column:
    return F.shiftright(dart, USE_BITS + 1)


def _opposite(dart: Column) -> Column:
    return dart.bitwiseXOR(F.lit(1))


def vertex_balance(graph: StringGraph) -> DataFrame:
    """``(v, inward, outward)``: traversals counted at the heads of each vertex."""
    heads = graph.edges.where(F.col("traversal_count") > 0).select(
        F.explode(F.array(
            F.struct(F.col("v1").alias("v"), (~F.col("v1_outward")).alias("inw"), "traversal_count"),
            F.struct(F.col("v2").alias("v"), F.col("v2_inward").alias("inw"), "traversal_count"),
        )).alias("h")
    ).select("h.*")
    t = F.col("traversal_count").cast("long")
    return heads.groupBy("v").agg(
        F.sum(F.when(F.col("inw"), t).otherwise(0)).alias("inward"),
        F.sum(F.when(F.col("inw"), 0).otherwise(t)).alias("outward"),
    )


def balance_violations(graph: StringGraph) -> DataFrame:
    """Vertices whose inward and outward traversals differ; empty if a cycle is possible."""
    return vertex_balance(graph).where(F.col("inward") != F.col("outward"))


def _used_edges(graph: StringGraph) -> DataFrame:
    """Written table of the used edges with dense numbers ``edge_no`` in the order of ids."""
    used = cut_lineage(dense_order(
        graph.edges.where(F.col("traversal_count") > 0).select(
            "edge_id", "v1", "v2", "v1_outward", "v2_inward", "traversal_count"), ["edge_id"], "edge_no"))
    top = used.agg(F.max("edge_no").alias("edges"), F.max("traversal_count").alias("uses")).first()
    if (top["edges"] or 0) >= MOST_EDGES or (top["uses"] or 0) > MOST_USES:
        raise ValueError(f"more than {MOST_EDGES} used edges or {MOST_USES} uses of one edge")
    return used


def _darts(used: DataFrame) -> DataFrame:
    uses = used.select(
        "v1", "v2", "v1_outward", "v2_inward", "edge_no",
        F.explode(F.sequence(F.lit(0), F.col("traversal_count") - 1)).alias("n"),
    )
    base = F.shiftleft(F.shiftleft(F.col("edge_no"), USE_BITS) + F.col("n"), 1)
    return uses.select(F.explode(F.array(
        F.struct(base.alias("dart"), F.col("v1").alias("v"), (~F.col("v1_outward")).alias("inward")),
        F.struct((base + 1).alias("dart"), F.col("v2").alias("v"), F.col("v2_inward").alias("inward")),
    )).alias("d")).select("d.*")


def _match(darts: DataFrame) -> DataFrame:
    """``(v, din, dout)``: inward and outward darts of a vertex paired by rank."""
    ranked = group_ranks(darts, ["v", "inward"], "dart", "rank")
    ins = ranked.where("inward").select("v", "rank", F.col("dart").alias("din"))
    outs = ranked.where(~F.col("inward")).select("v", "rank", F.col("dart").alias("dout"))
    return ins.join(outs, ["v", "rank"]).select("v", "din", "dout")


def _circuits(pairs: DataFrame) -> DataFrame:
    """Pairs with ``circuit``, the least use on the same closed circuit."""
    uses = pairs.select(_use(F.col("din")).alias("v")).distinct()
    links = pairs.select(_use(F.col("din")).alias("v1"), _use(F.col("dout")).alias("v2"))
    label = components(uses, links).select(F.col("v").alias("use"), F.col("component").alias("circuit"))
    return pairs.withColumn("use", _use(F.col("din"))).join(label, "use").drop("use")


def _meetings(pairs: DataFrame) -> DataFrame:
    """``(v, circuit, din, dout)``: one pair per vertex and circuit; map-side combine keeps a crowded vertex cheap."""
    return cut_lineage(pairs.groupBy("v", "circuit").agg(F.min(F.struct("din", "dout")).alias("rep")).select(
        "v", "circuit", "rep.din", "rep.dout"))


def _merge_round(pairs: DataFrame, rep: DataFrame, salt: int) -> DataFrame | None:
    """Merge circuits that share vertices; None if every circuit already stands alone.

    Circuits get random priorities. Each hooks to the busiest vertex where it meets one of
    lesser priority. The hooks form a forest, so rotating the partners of all circuits
    hooked at a vertex, together with its least circuit, joins each tree into one circuit.
    """
    rep = rep.withColumn("prio", F.xxhash64(F.col("circuit"), F.lit(salt)))
    total = rep.count()
    least = rep.groupBy("v").agg(
        F.min(F.struct("prio", "circuit")).alias("low"), F.count("*").alias("meeting")
    ).where(F.col("meeting") > 1)
    if least.isEmpty():
        return None
    hooks = cut_lineage(
        join_by_key(rep, least, "v", "meeting", total).where(F.struct("prio", "circuit") > F.col("low"))
        .groupBy("circuit")
        .agg(F.min(F.struct((-F.col("meeting")).alias("fewer"), F.col("low.prio"),
                            F.col("low.circuit").alias("to"), "v")).alias("h"))
        .select("circuit", F.col("h.to").alias("to"), F.col("h.v").alias("v"))
    )
    members = hooks.select("v", "circuit").union(hooks.select("v", "to")).distinct()
    seats = cut_lineage(group_ranks(members.join(rep, ["v", "circuit"]).select("v", "din", "dout"), ["v"], "din", "seat"))
    size = seats.groupBy("v").agg(F.count("*").alias("size"))
    next_out = seats.select("v", F.col("seat").alias("next_seat"), F.col("dout").alias("new_out"))
    turned = (
        join_by_key(seats, size, "v", "size", total)
        .withColumn("next_seat", (F.col("seat") + 1) % F.col("size"))
        .join(next_out, ["v", "next_seat"])
        .select("din", "new_out")
    )
    # A hook leads on where its target has one too; the others are the roots.
    ends = hooks.select(F.col("to").alias("circuit")).distinct().join(hooks.select("circuit"), "circuit", "left_anti")
    none = F.lit(0).cast("long")
    roots = follow(
        hooks.select(F.col("circuit").alias("id"), F.col("to").alias("ptr"), none.alias("dist"), none.alias("weight"), F.lit(False).alias("done"))
        .unionByName(ends.select(F.col("circuit").alias("id"), F.col("circuit").alias("ptr"), none.alias("dist"), none.alias("weight"),
                                 F.lit(True).alias("done")))
    ).select(F.col("id").alias("circuit"), F.col("ptr").alias("to"))
    return _rotated(pairs, turned, roots)


def _rotated(pairs: DataFrame, turned: DataFrame, roots: DataFrame) -> DataFrame:
    return cut_lineage(
        pairs.join(turned, "din", "left").join(roots, "circuit", "left")
        .select("v", "din", F.coalesce("new_out", "dout").alias("dout"),
                F.coalesce("to", "circuit").alias("circuit"))
    )


def _merge_meetings(rows: pd.DataFrame) -> pd.DataFrame:
    """All merges at once: at every vertex in turn, one pair of each circuit not yet joined rotates."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    turned: list[tuple[int, int]] = []
    for _, at in rows.sort_values(["v", "din"]).groupby("v", sort=True):
        if len(at) < 2:
            continue
        apart: dict[int, tuple[int, int]] = {}
        for circuit, din, dout in zip(at["circuit"], at["din"], at["dout"], strict=True):
            apart.setdefault(top(circuit), (din, dout))
        seats = list(apart.values())
        least = min(apart)
        for k, (din, _) in enumerate(seats if len(seats) > 1 else ()):
            turned.append((din, seats[(k + 1) % len(seats)][1]))
        for c in apart:
            root[c] = least
    named = [(c, top(c)) for c in rows["circuit"].unique()]
    return pd.DataFrame([(0, *t) for t in turned] + [(1, *c) for c in named], columns=["row", "a", "b"])


def closed_walks(graph: StringGraph, used: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``(v, din, dout, circuit)``: final partners, one circuit per component of used edges.

    Merge rounds shrink the meetings of circuits at vertices; once one task can hold them, it does the rest.
    """
    if not balance_violations(graph).isEmpty():
        raise ValueError("inward and outward traversals differ at some vertex")
    pairs = cut_lineage(_match(cut_lineage(_darts(used))))
    pairs = cut_lineage(_circuits(pairs))
    salt = 0
    while True:
        rep = _meetings(pairs)
        if rep.count() <= local_rows:
            merges = cut_lineage(in_one_task(rep, _merge_meetings, "row int, a long, b long"))
            return _rotated(pairs, merges.where("row = 0").selectExpr("a AS din", "b AS new_out"),
                            merges.where("row = 1").selectExpr("a AS circuit", "b AS to"))
        merged = _merge_round(pairs, rep, salt)
        if merged is None:
            return pairs
        pairs, salt = merged, salt + 1


def eulerian_cycle(graph: StringGraph) -> DataFrame:
    """``(circuit, step, edge_id, forward)``: the closed walks in order.

    ``circuit`` is the least edge on the walk. Each walk starts by leaving through its least
    outward dart; ``forward`` tells whether the edge is crossed from v1 to v2.
    """
    if graph.kind != "bidigraph":
        raise ValueError("the cycle is computed on a bidirected graph")
    used = _used_edges(graph)
    pairs = closed_walks(graph, used)
    heads = pairs.groupBy("circuit").agg(F.min("dout").alias("head")).join(
        pairs.select("dout", F.col("din").alias("head_mate")), F.col("head") == F.col("dout")
    ).select("circuit", "head", "head_mate")
    mate = pairs.select("circuit", F.explode(F.array(
        F.struct(F.col("din").alias("dart"), F.col("dout").alias("mate")),
        F.struct(F.col("dout").alias("dart"), F.col("din").alias("mate")),
    )).alias("m")).select("circuit", "m.*")
    # The dart before d is the far end of d's partner. The walk is cut open at its start in both
    # directions, which turns each direction into a list.
    cuts = heads.select(F.explode(F.array("head", "head_mate")).alias("dart"), F.lit(True).alias("cut"))
    none = F.lit(0).cast("long")
    state = follow(mate.join(cuts, "dart", "left").select(
        F.col("dart").alias("id"),
        F.when(F.col("cut"), F.col("dart")).otherwise(_opposite(F.col("mate"))).alias("ptr"),
        F.when(F.col("cut"), 0).otherwise(1).cast("long").alias("dist"), none.alias("weight"),
        F.coalesce("cut", F.lit(False)).alias("done"),
    )).join(mate.select(F.col("dart").alias("id"), "circuit"), "id").withColumnRenamed("id", "dart")
    steps = state.join(heads.select(F.col("head").alias("ptr")), "ptr", "left_semi").select(
        F.shiftright("circuit", USE_BITS).alias("circuit_no"),
        F.col("dist").alias("step"),
        _edge(F.col("dart")).alias("edge_no"),
        (F.col("dart") % 2 == 0).alias("forward"),
    )
    named = cut_lineage(steps.join(used.select("edge_no", "edge_id"), "edge_no"))
    # Merging keeps the name of some circuit; the least edge of all is known only now.
    least = named.groupBy("circuit_no").agg(F.min("edge_id").alias("circuit"))
    return named.join(least, "circuit_no").select("circuit", "step", "edge_id", "forward")


def cycle_violations(graph: StringGraph, cycle: DataFrame) -> DataFrame:
    """``(rule, id)``: edges used a wrong number of times and steps that do not follow on.

    The next step is found by an equi-join on the step number, not by a window over the
    whole walk.
    """
    used = cycle.groupBy("edge_id").agg(F.count("*").alias("n"))
    counts = graph.edges.select("edge_id", "traversal_count").join(used, "edge_id", "full").where(
        F.coalesce("traversal_count", F.lit(0)) != F.coalesce("n", F.lit(0))
    ).select(F.lit("count").alias("rule"), F.col("edge_id").alias("id"))
    ends = cycle.join(graph.edges.select("edge_id", "v1", "v2", "v1_outward", "v2_inward"), "edge_id")
    fwd = F.col("forward")
    walk = ends.select(
        "circuit", "step",
        F.when(fwd, F.col("v1")).otherwise(F.col("v2")).alias("leaves"),
        F.when(fwd, ~F.col("v1_outward")).otherwise(F.col("v2_inward")).alias("leaves_inward"),
        F.when(fwd, F.col("v2")).otherwise(F.col("v1")).alias("enters"),
        F.when(fwd, F.col("v2_inward")).otherwise(~F.col("v1_outward")).alias("enters_inward"),
    )
    size = cycle.groupBy("circuit").agg(F.count("*").alias("size"))
    after = walk.select("circuit", F.col("step").alias("next"), F.col("leaves").alias("n_leaves"),
                        F.col("leaves_inward").alias("n_inward"))
    broken = (
        walk.join(size, "circuit").withColumn("next", (F.col("step") + 1) % F.col("size"))
        .join(after, ["circuit", "next"], "left")
        .where(F.col("n_leaves").isNull() | (F.col("n_leaves") != F.col("enters"))
               | (F.col("n_inward") == F.col("enters_inward")))
        .select(F.lit("order").alias("rule"), F.col("step").alias("id"))
    )
    return counts.unionByName(broken)
