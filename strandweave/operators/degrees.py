"""Vertex degrees, graph statistics and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.pointers import LOCAL_ROWS, in_one_task, join_by_key
from strandweave.operators.string_graph import StringGraph
from strandweave.session import cut_lineage

# Links that one task holds at a time while it thins out its partition.
FOREST_ROWS = 2_000_000


def vertex_degrees(graph: StringGraph) -> DataFrame:
    """``(v, in_degree, out_degree)`` of every vertex, isolated ones included.

    Both ends of all edges and the vertices themselves go through one aggregation with
    map-side combine.
    """
    if graph.kind == "digraph":
        out1, in2 = F.lit(1), F.lit(1)
    else:
        out1, in2 = F.col("v1_outward").cast("int"), F.col("v2_inward").cast("int")
    ends = graph.edges.select(
        F.explode(F.array(
            F.struct(F.col("v1").alias("v"), (1 - out1).alias("i"), out1.alias("o")),
            F.struct(F.col("v2").alias("v"), in2.alias("i"), (1 - in2).alias("o")),
        )).alias("x")
    ).select("x.*")
    every = graph.vertices.select("v", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionByName(every).groupBy("v").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


def inner_vertices(graph: StringGraph) -> DataFrame:
    """``(v)`` with exactly one edge in and one out."""
    return vertex_degrees(graph).where((F.col("in_degree") == 1) & (F.col("out_degree") == 1)).select("v")


def degree_histogram(graph: StringGraph) -> DataFrame:
    """``(in_degree, out_degree, vertices)``."""
    return vertex_degrees(graph).groupBy("in_degree", "out_degree").agg(F.count("*").alias("vertices"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side."""
    names = [c for part in parts for c in part.columns]
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in names])


def _degree_row(graph: StringGraph) -> DataFrame:
    i, o = F.col("in_degree"), F.col("out_degree")
    return vertex_degrees(graph).agg(
        F.count("*").alias("vertices"),
        F.count_if((i == 0) & (o == 0)).alias("isolated"),
        F.count_if((i == 1) & (o == 1)).alias("inner_vertices"),
        F.count_if((i == 0) & (o == 1)).alias("branch_begins"),
        F.count_if((i == 1) & (o == 0)).alias("branch_ends"),
        F.count_if(i != o).alias("unequal_degrees"),
        F.coalesce(F.max(i), F.lit(0)).alias("max_in_degree"),
        F.coalesce(F.max(o), F.lit(0)).alias("max_out_degree"),
    )


def digraph_stats(graph: StringGraph) -> DataFrame:
    """One row of vertex, edge, degree and mapped-read figures."""
    edges = graph.edges.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("mapped_read_count") > 1).alias("edges_with_mapped_reads"),
        F.coalesce(F.avg("mapped_read_count"), F.lit(0.0)).alias("mean_mapped_reads"),
    )
    return _one_row(_degree_row(graph), edges)


def bidigraph_stats(graph: StringGraph) -> DataFrame:
    """As ``digraph_stats`` for edge heads, with the count of each orientation."""
    out1, in2 = F.col("v1_outward"), F.col("v2_inward")
    edges = graph.edges.agg(
        F.count("*").alias("edges"),
        F.count_if(out1 == in2).alias("edges_through"),
        F.count_if(~out1 & in2).alias("edges_outward"),
        F.count_if(out1 & ~in2).alias("edges_inward"),
    )
    return _one_row(_degree_row(graph), edges)


def mean_degree(graph: StringGraph) -> DataFrame:
    """One row: edges per vertex."""
    v = graph.vertices.agg(F.count("*").alias("vertices"))
    e = graph.edges.agg(F.count("*").alias("edges"))
    return _one_row(v, e).withColumn(
        "mean_degree", F.when(F.col("vertices") == 0, 0.0).otherwise(F.col("edges") / F.col("vertices"))
    )


def components(vertices: DataFrame, edges: DataFrame, local_rows: int | None = None) -> DataFrame:
    """``(v, component)``: weakly connected components named by their least vertex.

    Every partition first keeps only a spanning forest of its own links. What is left goes to one task
    if it is few, else two local rewirings alternate until nothing moves: every vertex links
    its larger neighbours to its least neighbour, then its smaller ones. This takes a logarithmic number of
    rounds even on long paths, each a grouped minimum with map-side combine and one join
    in which crowded vertices are looked up by broadcast.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    ends = edges.where(F.col("v1") != F.col("v2")).select(
        F.greatest("v1", "v2").cast("long").alias("hi"), F.least("v1", "v2").cast("long").alias("lo"))
    links = cut_lineage(ends.mapInPandas(_forest_of_partition, "hi long, lo long").distinct())
    total = links.count()
    if total <= local_rows:
        links = in_one_task(links, _forest, "hi long, lo long")
    else:
        state = None
        while True:
            links = cut_lineage(_small_star(_large_star(links, 2 * total), total))
            total, mark = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
            if (total, mark) == state:
                break
            state = (total, mark)
    return vertices.select("v").join(
        links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("lo")), "v", "left"
    ).select("v", F.coalesce("lo", "v").alias("component"))


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of every vertex to the least one that these links connect it with."""
    hi, lo = rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)
    names, place = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = place[:len(hi)], place[len(hi):]
    root = np.arange(len(names))
    while len(a):
        # The larger root of every link hooks to the smaller, then all hooks are followed to their end.
        np.minimum.at(root, a, b)
        while not np.array_equal(root, root[root]):
            root = root[root]
        a, b = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        open_links = a != b
        a, b = a[open_links], b[open_links]
    led = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"hi": names[led], "lo": names[root[led]]})


def _forest_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One forest of a partition's links, batch after batch; at most a row per vertex is held."""
    held = None
    for batch in batches:
        held = _forest(batch if held is None else pd.concat([held, batch], ignore_index=True))
        if len(held) > FOREST_ROWS:
            yield held
            held = None
    if held is not None:
        yield held


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("hi", "lo").union(links.select(F.col("lo"), F.col("hi"))).toDF("u", "x")
    least = both.groupBy("u").agg(F.min("x").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return (
        join_by_key(both.where(F.col("x") > F.col("u")), least, "u", "n", total)
        .select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(links: DataFrame, total: int) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(links, least, "hi", "n", total).where(F.col("lo") != F.col("m")).select(
        F.col("lo").alias("hi"), F.col("m").alias("lo")
    )
    return moved.union(least.select("hi", "m")).distinct()


def component_sizes(graph: StringGraph) -> DataFrame:
    """``(component, vertices)``."""
    return components(graph.vertices, graph.edges).groupBy("component").agg(
        F.count("*").alias("vertices")
    )
