"""Connected components of an edge table by alternating large and small stars.

Every round is a grouped minimum (combined before the shuffle) and one join; the number
of rounds grows with the logarithm of the longest path. Rounds are written to the
shared folder, so that a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import write_stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows ``(u, v)``: link each node's neighbours to the least of them."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # only towards smaller nodes
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``, longs; a label is its component's least node."""
    edges = write_stage(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        edges = write_stage(_star(_star(edges, True), False), "edges")
        after = _sum(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label")).distinct()
