"""Mapping of contained reads onto the edges in which their ends lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.collapse import path_positions
from strandweave.operators.containment import f_inside, g_inside
from strandweave.operators.string_graph import StringGraph, edge_len
from strandweave.session import cut_lineage

# Path counts of a walk through repeats can pass 64 bits.
PATHS = "decimal(38,0)"

PLACEMENT = ("read_id", "container", "read", "before", "after", "rc", "f", "g", "type")


def containers(overlaps: DataFrame, index_map: DataFrame) -> DataFrame:
    """Placements of contained reads in uncontained ones.

    ``(read_id, container, read, before, after, rc, f, g, type)``: ``read`` is the new number
    of ``container``, and ``before`` and ``after`` are its bases on either side.
    """
    new = index_map.where(F.col("new_id").isNotNull()).select(
        F.col("old_id").alias("container"), F.col("new_id").alias("read"))
    inner_is_f = f_inside()
    rows = overlaps.where(f_inside() | g_inside()).select(
        F.when(inner_is_f, F.col("f")).otherwise(F.col("g")).alias("read_id"),
        F.when(inner_is_f, F.col("g")).otherwise(F.col("f")).alias("container"),
        F.when(inner_is_f, F.col("g_beg")).otherwise(F.col("f_beg")).alias("before"),
        F.when(inner_is_f, F.col("g_len") - F.col("g_end") - 1)
        .otherwise(F.col("f_len") - F.col("f_end") - 1).alias("after"),
        "rc", "f", "g", ((F.col("f_beg") > 0).cast("int") * 2 + F.col("rc").cast("int")).alias("type"),
    )
    return rows.join(new, "container").select(*PLACEMENT)


def nearest_containers(placements: DataFrame) -> DataFrame:
    """Nearest uncontained container on each side of every contained read.

    ``(read_id, overhang, over_read, over_rc, underhang, under_read, under_rc)`` with new
    container numbers. Ties go to the first overlap in (f, g, type) order.
    """
    tie = ["f", "g", "type", "read", "rc"]
    over = F.when(F.col("rc"), F.col("before")).otherwise(F.col("after"))
    under = F.when(F.col("rc"), F.col("after")).otherwise(F.col("before"))
    return (
        placements.groupBy("read_id")
        .agg(
            F.min(F.struct(over.alias("gap"), *tie)).alias("o"),
            F.min(F.struct(under.alias("gap"), *tie)).alias("u"),
        )
        .select(
            "read_id",
            F.col("o.gap").alias("overhang"), F.col("o.read").alias("over_read"),
            F.col("o.rc").alias("over_rc"),
            F.col("u.gap").alias("underhang"), F.col("u.read").alias("under_read"),
            F.col("u.rc").alias("under_rc"),
        )
    )


def contained_overhangs(overlaps: DataFrame, index_map: DataFrame) -> DataFrame:
    """``nearest_containers`` straight from an overlap relation."""
    return nearest_containers(containers(overlaps, index_map))


def walk_starts(overhangs: DataFrame) -> DataFrame:
    """``(v, residual, reads)``: distinct walk starts and how many read ends share them.

    A forward read leaves its container through E on the overhang side and through B on
    the underhang side; a reversed read the other way round. Equal starts give equal walks, so many
    copies of one read cost one walk.
    """
    sides = F.array(
        F.struct((F.col("over_read") * 2 + F.when(F.col("over_rc"), 0).otherwise(1)).alias("v"),
                 F.col("overhang").alias("residual")),
        F.struct((F.col("under_read") * 2 + F.when(F.col("under_rc"), 1).otherwise(0)).alias("v"),
                 F.col("underhang").alias("residual")),
    )
    return (
        overhangs.select(F.explode(sides).alias("s"))
        .groupBy("s.v", "s.residual")
        .agg(F.count("*").alias("reads"))
    )


def walk_back(starts: DataFrame, edges: DataFrame, cap: int | None = None, positions: DataFrame | None = None) -> DataFrame:
    """``(v, residual, edge_id, hits)``: edges a walk against the edges ends in.

    From a vertex, every incoming edge longer than the residual is a hit; a shorter one is walked
    and its length taken off. An edge reached along several paths counts once per path.
    Every walk is kept; only if a caller gives ``cap``, those with as many hits or more are left out.

    A round takes a walk over a whole unbranched path: from the end of an edge it knows, by the offsets
    of ``path_positions``, whether it ends on that path and at which base. Only at a path's first vertex
    does it go on, so rounds count branchings and not edges. Equal states of a walk are merged with
    their path count each round. At last one join by (path, stretch of bases) finds the edge of every hit.
    """
    if positions is None:
        positions = cut_lineage(path_positions(edges, cut_rings=True))
    lengths = edges.select("edge_id", "v1", "v2", edge_len(edges).cast("long").alias("len"))
    placed = lengths.join(positions.where(F.col("head").isNotNull()).select("edge_id", "head", "offset"), "edge_id", "left").select(
        "edge_id", "v1", "v2", "len", F.coalesce("head", "edge_id").alias("head"), F.coalesce("offset", F.lit(0)).alias("start"))
    placed = cut_lineage(placed)
    begins = placed.where(F.col("edge_id") == F.col("head")).select("head", F.col("v1").alias("from"))
    into = placed.select(F.col("v2").alias("at"), "head", (F.col("start") + F.col("len")).alias("end"))
    front = starts.select("v", "residual", F.col("v").alias("at"),
                          F.col("residual").cast("long").alias("left"), F.lit(1).cast(PATHS).alias("paths"))
    rounds = []
    while True:
        step = cut_lineage(front.join(into, "at").select(
            "v", "residual", "head", (F.col("end") - F.col("left")).alias("base"), "paths"))
        rounds.append(step.where(F.col("base") > 0).select("v", "residual", "head", "base", "paths"))
        walking = step.where(F.col("base") <= 0)
        if walking.isEmpty():
            break
        front = walking.join(begins, "head").groupBy("v", "residual", F.col("from").alias("at"), (-F.col("base")).alias("left")).agg(
            F.sum("paths").cast(PATHS).alias("paths"))
    # Bases of a path are counted from 1, so an edge holds those from start + 1 to its end.
    mean = placed.agg(F.avg("len")).first()[0] or 1.0
    width = 1 << max(4, int(mean - 1).bit_length())
    stretch = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("len") - 1) / width))
    spans = placed.select("edge_id", "head", "start", "len", F.explode(stretch).alias("stretch"))
    hits = reduce(DataFrame.unionByName, rounds).withColumn("stretch", F.floor((F.col("base") - 1) / width)).join(
        spans, ["head", "stretch"]).where((F.col("base") > F.col("start")) & (F.col("base") <= F.col("start") + F.col("len")))
    per_edge = hits.groupBy("v", "residual", "edge_id").agg(F.sum("paths").cast(PATHS).alias("hits"))
    if cap is None:
        return per_edge
    spent = per_edge.groupBy("v", "residual").agg(F.sum("hits").alias("n")).where(F.col("n") >= cap)
    return per_edge.join(spent.select("v", "residual"), ["v", "residual"], "left_anti")


def mapped_read_counts(starts: DataFrame, hits: DataFrame) -> DataFrame:
    """``(edge_id, added)``: each read end adds 1/n to each of its n hits."""
    totals = hits.groupBy("v", "residual").agg(F.sum("hits").alias("n"))
    return (
        hits.join(totals, ["v", "residual"])
        .join(starts, ["v", "residual"])
        .groupBy("edge_id")
        .agg(F.sum(F.col("reads") * F.col("hits").cast("double") / F.col("n").cast("double")).alias("added"))
    )


def map_contained(graph: StringGraph, overlaps: DataFrame, index_map: DataFrame) -> StringGraph:
    """Graph whose mapped read counts include the contained reads.

    Runs before the collapse: vertices must still be numbered by uncontained read.
    """
    return map_placements(graph, containers(overlaps, index_map))


def map_placements(graph: StringGraph, placements: DataFrame, positions: DataFrame | None = None) -> StringGraph:
    """``map_contained`` for placements from any source; ``positions`` as of ``walk_back``."""
    if graph.kind != "digraph":
        raise ValueError("contained reads map onto a directed graph")
    starts = cut_lineage(walk_starts(nearest_containers(placements)))
    added = mapped_read_counts(starts, walk_back(starts, graph.edges, positions=positions))
    columns = graph.edges.columns
    edges = (
        graph.edges.join(added, "edge_id", "left")
        .withColumn("mapped_read_count",
                    F.col("mapped_read_count") + F.coalesce("added", F.lit(0.0)))
        .select(*columns)
    )
    return graph.with_edges(edges)
