"""Contig sequences along the cycle.

A cycle is cut wherever it runs over a special edge. Each remaining walk is a contig: the read it starts
in, in the direction it is left, followed by the label of every edge. The text stays in
pieces, one per row; no task joins a contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import reverse_complement
from strandweave.operators.ranking import dense_order, running_total
from strandweave.operators.string_graph import StringGraph, as_rope
from strandweave.session import cut_lineage
from strandweave.sources.reads import FASTA_WIDTH


def contig_walks(graph: StringGraph, cycle: DataFrame) -> DataFrame:
    """``(contig, piece, circuit, step, edge_id, forward)``: the edges of each contig in order, from piece 1.

    A circuit without a special edge is one contig from its first step; otherwise the walk before
    its first special edge continues the one after its last.
    """
    if graph.kind != "bidigraph":
        raise ValueError("contigs follow a cycle of a bidirected graph")
    special = F.col("is_special").cast("long")
    steps = cycle.join(graph.edges.select("edge_id", "is_special"), "edge_id")
    placed = cut_lineage(running_total(
        dense_order(steps.withColumn("special", special), ["circuit", "step"], "place"), "place", "special", "before"))
    circuits = placed.groupBy("circuit").agg(
        F.min("before").alias("base"), F.sum("special").alias("cuts"), F.count("*").alias("size"))
    numbered = placed.join(circuits, "circuit").withColumn("nth", F.col("before") - F.col("base"))
    starts = numbered.where("is_special").select("circuit", (F.col("nth") + 1).alias("segment"), (F.col("step") + 1).alias("start"))
    first = (F.col("nth") == 0) & (F.col("cuts") > 0)
    walks = (
        numbered.where("not is_special")
        .withColumn("segment", F.when(first, F.col("cuts")).otherwise(F.col("nth")))
        .join(starts, ["circuit", "segment"], "left")
        .withColumn("piece", F.col("step") - F.coalesce("start", F.lit(0)) + F.when(first, F.col("size")).otherwise(0) + 1)
    )
    contigs = dense_order(walks.select("circuit", "segment").distinct(), ["circuit", "segment"], "contig")
    return walks.join(contigs, ["circuit", "segment"]).select("contig", "piece", "circuit", "step", "edge_id", "forward")


def contig_pieces(graph: StringGraph, cycle: DataFrame, reads: DataFrame) -> DataFrame:
    """``(contig, piece, seq)``: piece 0 is the first read, the others the labels of its edges in order.

    A label that is a rope stays in its own pieces. ``reads`` are the uncontained reads the vertices are numbered by.
    """
    graph = as_rope(graph)
    walks = cut_lineage(contig_walks(graph, cycle))
    forward = F.col("forward")
    labels = walks.select("contig", "piece", "edge_id", F.when(forward, 0).otherwise(1).alias("part")).join(
        graph.pieces, ["edge_id", "part"]).select("contig", "piece", "offset", "seq")
    # A walk that leaves its first read through the end reads it as it is, else reversed.
    first = walks.where("piece = 1").join(graph.edges.select("edge_id", "v1", "v2", "v1_outward", "v2_inward"), "edge_id").select(
        "contig", F.when(forward, F.col("v1")).otherwise(F.col("v2")).alias("read_id"),
        F.when(forward, F.col("v1_outward")).otherwise(~F.col("v2_inward")).alias("as_is"))
    opening = first.join(reads, "read_id").select(
        "contig", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("offset"),
        F.when(F.col("as_is"), F.col("seq")).otherwise(reverse_complement("seq")).alias("seq"))
    placed = dense_order(opening.unionByName(labels), ["contig", "piece", "offset"], "place")
    base = placed.where("piece = 0").select("contig", F.col("place").alias("base"))
    return placed.join(base, "contig").select("contig", (F.col("place") - F.col("base")).alias("piece"), "seq")


def contig_lengths(pieces: DataFrame) -> DataFrame:
    """``(contig, pieces, bases)``."""
    return pieces.groupBy("contig").agg(F.count("*").alias("pieces"), F.sum(F.length("seq")).alias("bases"))


def contig_fasta(pieces: DataFrame) -> DataFrame:
    """``(contig, piece, line)``: FASTA lines in order of contig and piece, wrapped like other output.

    ``piece`` counts the lines of a contig from 0; its header has -1. Running totals place every piece in its
    contig, pieces are cut where lines end, and a line is joined from its cuts: no task holds a contig.
    """
    sized = pieces.withColumn("n", F.length("seq").cast("long"))
    ordered = dense_order(sized, ["contig", "piece"], "place")
    placed = cut_lineage(running_total(ordered, "place", "n", "before"))
    base = placed.groupBy("contig").agg(F.min("before").alias("base"))
    begin = F.col("before") - F.col("base")
    cuts = placed.join(base, "contig").where("n > 0").select(
        "contig", "seq", begin.alias("begin"), (begin + F.col("n")).alias("end"),
        F.explode(F.sequence(F.floor(begin / FASTA_WIDTH), F.floor((begin + F.col("n") - 1) / FASTA_WIDTH))).alias("row"))
    low = F.greatest("begin", F.col("row") * FASTA_WIDTH)
    size = F.least("end", (F.col("row") + 1) * FASTA_WIDTH) - low
    parts = cuts.select("contig", "row", low.alias("low"), F.substring(
        F.col("seq"), (low - F.col("begin") + 1).cast("int"), size.cast("int")).alias("text"))
    # At most FASTA_WIDTH cuts make up a line.
    lines = parts.groupBy("contig", "row").agg(F.array_sort(F.collect_list(F.struct("low", "text"))).alias("p")).select(
        "contig", F.col("row").alias("piece"), F.array_join(F.col("p.text"), "").alias("line"))
    headers = pieces.where("piece = 0").select(
        "contig", F.lit(-1).cast("long").alias("piece"), F.concat(F.lit(">contig_"), (F.col("contig") + 1).cast("string")).alias("line"))
    return headers.unionByName(lines)
