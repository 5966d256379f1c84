"""Contraction of unbranched paths.

Labels are ropes here: a path's label is the pieces of its edges, each with its offset on the path. No
row, group or task holds the text of a path.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.pointers import follow, ring_names
from strandweave.operators.string_graph import StringGraph, as_rope, edge_len, to_bidigraph, to_digraph, with_text
from strandweave.session import cut_lineage


def _inner_of(edges: DataFrame) -> DataFrame:
    """``(v)`` with exactly one edge in and one out, of the edges alone."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("v1").alias("v"), F.lit(0).alias("i")), F.struct(F.col("v2").alias("v"), F.lit(1).alias("i")),
    )).alias("x")).select("x.*")
    return ends.groupBy("v").agg(F.sum("i").alias("ins"), F.count("*").alias("all")).where("ins = 1 AND all = 2").select("v")


def path_positions(edges: DataFrame, cut_rings: bool = False) -> DataFrame:
    """``(edge_id, head, pos, offset)`` of the edges on unbranched paths of a directed graph.

    ``head`` is the path's first edge, ``pos`` the edge's place on it and ``offset`` the bases before it. For
    edges on smooth rings, which no branching vertex reaches, ``head`` is null; with ``cut_rings``
    a ring is the path that begins with its least edge.
    """
    inner = _inner_of(edges)
    ends = edges.select("edge_id", "v1", "v2", edge_len(edges).cast("long").alias("len"))
    into = ends.join(inner.withColumnRenamed("v", "v2"), "v2").select(
        F.col("v2").alias("v1"), F.col("edge_id").alias("prev"), F.col("len").alias("prev_len"))
    on_path = ends.join(into, "v1", "left").join(
        inner.select(F.col("v").alias("v2"), F.lit(True).alias("goes_on")), "v2", "left"
    ).where(F.col("prev").isNotNull() | F.col("goes_on"))
    state = follow(on_path.select(
        F.col("edge_id").alias("id"), F.coalesce("prev", "edge_id").alias("ptr"),
        F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.coalesce("prev_len", F.lit(0)).cast("long").alias("weight"), F.col("prev").isNull().alias("done")))
    if cut_rings and not state.where(~F.col("done")).isEmpty():
        rings = state.where(~F.col("done")).select(F.col("id").alias("edge_id"))
        step = rings.join(on_path.select("edge_id", "prev", "prev_len"), "edge_id")
        named = ring_names(step.select(F.col("edge_id").alias("id"), F.col("prev").alias("ptr"))).withColumnRenamed("id", "edge_id")
        first = F.col("edge_id") == F.col("ring")
        opened = follow(step.join(named, "edge_id").select(
            F.col("edge_id").alias("id"), F.when(first, F.col("edge_id")).otherwise(F.col("prev")).alias("ptr"),
            F.when(first, 0).otherwise(1).cast("long").alias("dist"),
            F.when(first, 0).otherwise(F.col("prev_len")).cast("long").alias("weight"), first.alias("done")))
        state = state.where("done").unionByName(opened)
    done = F.col("done")
    return state.select(F.col("id").alias("edge_id"), F.when(done, F.col("ptr")).alias("head"),
                        F.when(done, F.col("dist")).alias("pos"), F.when(done, F.col("weight")).alias("offset"))


def collapse_unbranched(graph: StringGraph, positions: DataFrame | None = None) -> StringGraph:
    """Each unbranched path becomes one edge that keeps the id and attributes of its first edge.

    The label is that of all edges in path order, and mapped counts are added. The twin of a path is the
    path that starts with the twin of its last edge. Smooth rings stay as they are.
    A bidirected path keeps the id of its first edge in the direction it is stored in, and
    adds up the mapped counts. A graph with text labels gives one with text labels.
    """
    if graph.kind == "bidigraph":
        merged = to_bidigraph(collapse_unbranched(to_digraph(graph, keep_attributes=True)))
        halved = merged.with_edges(merged.edges.withColumn("edge_id", F.shiftright("edge_id", 1)))
        return halved if merged.pieces is None else replace(
            halved, pieces=merged.pieces.withColumn("edge_id", F.shiftright("edge_id", 1)))
    if graph.pieces is None:
        return with_text(collapse_unbranched(as_rope(graph), positions))
    if positions is None:
        positions = cut_lineage(path_positions(graph.edges))
    return _contract(graph, positions)


def _contract(graph: StringGraph, positions: DataFrame) -> StringGraph:
    on_path = positions.where(F.col("head").isNotNull())
    totals = graph.edges.join(on_path, "edge_id").groupBy("head").agg(
        F.max(F.struct("pos", "v2", "twin_id")).alias("last"),
        F.sum("mapped_read_count").alias("path_mapped"), F.sum("len").alias("path_len"))
    paths = (
        totals.withColumnRenamed("head", "edge_id")
        .join(graph.edges.drop("twin_id", "v2", "len", "mapped_read_count", "num_inner_vertices"), "edge_id")
        .select(
            "edge_id",
            F.col("last.twin_id").alias("twin_id"),
            "v1",
            F.col("last.v2").alias("v2"),
            F.col("path_len").alias("len"),
            F.col("path_mapped").alias("mapped_read_count"),
            F.col("last.pos").cast("int").alias("num_inner_vertices"),
            "a_statistic", "traversal_count", "is_special",
        )
    )
    rest = graph.edges.join(on_path.select("edge_id"), "edge_id", "left_anti").select(*paths.columns)
    # Every edge of a path but its first leaves a vertex that goes.
    removed = graph.edges.join(on_path.where("pos > 0").select("edge_id"), "edge_id").select(F.col("v1").alias("v"))
    pieces = graph.pieces.join(on_path.select("edge_id", "head", F.col("offset").alias("before")), "edge_id", "left").select(
        F.coalesce("head", "edge_id").alias("edge_id"), "part", (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset"), "seq")
    return replace(graph.with_edges(paths.unionByName(rest), graph.vertices.join(removed, "v", "left_anti")), pieces=pieces)


def smooth_rings(graph: StringGraph, positions: DataFrame | None = None) -> DataFrame:
    """``(ring, vertices, bases)`` per ring of inner vertices; ``ring`` is its least edge id."""
    if positions is None:
        positions = cut_lineage(path_positions(graph.edges))
    edges = graph.edges.join(
        positions.where(F.col("head").isNull()).select("edge_id"), "edge_id"
    ).select("edge_id", "v1", "v2", edge_len(graph.edges).alias("len"))
    after = edges.select(F.col("v1").alias("v2"), F.col("edge_id").alias("ptr"))
    named = ring_names(edges.join(after, "v2").select(F.col("edge_id").alias("id"), "ptr")).withColumnRenamed("id", "edge_id")
    return edges.join(named, "edge_id").groupBy("ring").agg(F.count("*").alias("vertices"), F.sum("len").alias("bases"))
