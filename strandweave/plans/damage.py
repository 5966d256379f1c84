"""Damage done to sound tables by rules on their numbers, so that validators have something to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.ranking import dense_order
from strandweave.operators.string_graph import StringGraph

FAR = 1_000_000_000


def _changed(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[c].cast(df.schema[c].dataType).alias(c) if c in columns else c for c in df.columns])


def overlaps(found: DataFrame) -> DataFrame:
    """Ends moved, strands swapped, reads renamed and overlaps cut short, by ``(f + 3 g) mod 11``."""
    k = (F.col("f") + 3 * F.col("g")) % 11
    return _changed(
        found,
        f=F.when(k == 4, F.col("f") + FAR).otherwise(F.col("f")),
        f_beg=F.when((k == 6) & (F.col("f_beg") > 0), F.col("f_beg") - 1).otherwise(F.col("f_beg")),
        f_end=F.when(k == 1, F.col("f_end") + 1).when(k == 5, F.col("f_beg") + 9)
        .when((k == 6) & (F.col("f_beg") > 0), F.col("f_end") - 1).otherwise(F.col("f_end")),
        g_beg=F.when(k == 2, F.col("g_beg") - 1).otherwise(F.col("g_beg")),
        g_end=F.when(k == 5, F.col("g_beg") + 9).otherwise(F.col("g_end")),
        rc=F.when(k == 3, ~F.col("rc")).otherwise(F.col("rc")),
    )


def digraph(graph: StringGraph) -> StringGraph:
    """Every 11th edge dropped, every 13th without its tail, every 7th led elsewhere."""
    e = F.col("edge_id")
    kept = graph.edges.where(e % 11 != 5)
    return graph.with_edges(_changed(
        kept, v1=F.when(e % 13 == 4, F.col("v1") + FAR).otherwise(F.col("v1")),
        v2=F.when(e % 7 == 3, F.col("v2").bitwiseXOR(F.lit(2))).otherwise(F.col("v2"))))


def bidigraph(graph: StringGraph) -> StringGraph:
    """Every 7th edge without its first vertex, every 11th without a label."""
    e = F.col("edge_id")
    return graph.with_edges(_changed(
        graph.edges, v1=F.when(e % 7 == 3, F.col("v1") + FAR).otherwise(F.col("v1")),
        seq12=F.when(e % 11 == 5, F.lit(None)).otherwise(F.col("seq12"))))


def traversed(graph: StringGraph, modulus: int) -> StringGraph:
    """Traversal counts by edge id."""
    return graph.with_edges(_changed(graph.edges, traversal_count=F.col("edge_id") % modulus))


RING = 7


def ringed(graph: StringGraph) -> StringGraph:
    """Edges in the order of their ids, seven at a time, made into rings; some rings lack their fourth edge.

    Edges left over at the end are dropped.
    """
    rows = dense_order(graph.edges, ["edge_id"], "n")
    total = graph.edges.count()
    rows = rows.where(F.col("n") < total - total % RING)
    first = F.col("n") - F.col("n") % RING
    v2 = F.when(F.col("n") % RING == RING - 1, first).otherwise(F.col("n") + 1)
    edges = _changed(rows.where(~((F.col("n") % RING == 3) & (F.floor(F.col("n") / RING) % 3 == 0))), v1=F.col("n"), v2=v2)
    return graph.with_edges(edges.drop("n"))


def priced(graph: StringGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of a graph, and flows and prices by rules on edge and vertex ids."""
    flows = graph.edges.select("edge_id", (F.col("edge_id") % 4).cast("long").alias("flow"))
    v, limit = F.col("v"), F.lit(1_000_000)
    hub = graph.vertices.where(~F.col("is_special")).select(
        "v", F.when(v % 5 == 1, v % 3).otherwise(0).cast("long").alias("fill"),
        F.when(v % 5 == 2, v % 2).otherwise(0).cast("long").alias("spill"),
        F.when(v % 7 == 0, limit).when(v % 7 == 1, -limit).when(v % 7 == 2, limit + 5).when(v % 7 == 3, -limit - 5)
        .otherwise(v % 3).cast("long").alias("price"))
    return graph.edges, flows, hub


def mirrored(graph: StringGraph) -> StringGraph:
    """Bidirected graph with every edge and its image with both heads turned, each to be used once.

    Inward and outward uses are then equal at every vertex.
    """
    once = F.lit(1)
    images = graph.edges.select(*[
        (F.col("edge_id") * 2 + 1).alias(c) if c == "edge_id" else (~F.col(c)).alias(c) if c in ("v1_outward", "v2_inward") else
        once.alias(c) if c == "traversal_count" else c for c in graph.edges.columns])
    return graph.with_edges(_changed(graph.edges, edge_id=F.col("edge_id") * 2, traversal_count=once).unionByName(images))


def listed_cycle(graph: StringGraph) -> DataFrame:
    """Edges of a graph in the order of their ids, passed off as a cycle."""
    rows = dense_order(graph.edges.select("edge_id"), ["edge_id"], "step")
    return rows.select(F.lit(0).cast("long").alias("circuit"), "step", "edge_id", (F.col("edge_id") % 3 == 0).alias("forward"))
