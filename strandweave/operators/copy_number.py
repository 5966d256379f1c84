"""Arrival-rate statistics that tell single-copy edges from repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.string_graph import StringGraph, edge_len

# Fixed values of the statistic.
SINGLE_COPY_THRESHOLD = 17.0
BOOTSTRAP_ROUNDS = 3
# Mapped counts are sums of fractions; one this close below a whole number is that number.
COUNT_TOLERANCE = 1e-6
LN2 = math.log(2.0)


def bootstrap_genome_len(graph: StringGraph) -> DataFrame:
    """One row: bases on edges that leave E vertices, i.e. one strand of each path."""
    return graph.edges.agg(
        F.coalesce(F.sum(F.when(F.col("v1") % 2 == 1, edge_len(graph.edges))), F.lit(0)).alias("genome_len")
    )


def _statistic(rate: Column) -> Column:
    return rate * F.col("len") - F.col("reads") * F.lit(LN2)


def _whole_reads() -> Column:
    return F.floor(F.col("mapped_read_count") + COUNT_TOLERANCE)


def _measured(graph: StringGraph) -> DataFrame:
    return graph.edges.select(
        "edge_id", edge_len(graph.edges).alias("len"), _whole_reads().alias("reads")
    )


def _rates(graph: StringGraph, num_reads: int | None) -> list[float]:
    """The first arrival rate, then one per bootstrap round.

    A round keeps the edges that look single-copy under its rate and estimates the next
    rate from them. One number passes from round to round.
    """
    n = graph.orig_num_reads if num_reads is None else num_reads
    genome_len = bootstrap_genome_len(graph).first()[0]
    rates = [n / genome_len if genome_len else 0.0]
    edges = _measured(graph)
    for _ in range(BOOTSTRAP_ROUNDS):
        single = edges.where(_statistic(F.lit(rates[-1])) >= SINGLE_COPY_THRESHOLD)
        reads, size = single.agg(F.sum("reads"), F.sum("len")).first()
        rates.append(reads / size if size else 0.0)
    return rates


def arrival_rates(graph: StringGraph, num_reads: int | None = None) -> DataFrame:
    """One row ``(rate0 .. rate3)``: reads per base before and after each bootstrap round."""
    rates = _rates(graph, num_reads)
    names = ", ".join(f"rate{i} double" for i in range(len(rates)))
    return graph.edges.sparkSession.createDataFrame([tuple(rates)], names)


def a_statistics(graph: StringGraph, num_reads: int | None = None) -> StringGraph:
    """Graph with the A-statistic of the last bootstrap round on every edge."""
    rate = F.lit(_rates(graph, num_reads)[BOOTSTRAP_ROUNDS - 1])
    columns = graph.edges.columns
    edges = (
        graph.edges.withColumn("len", edge_len(graph.edges))
        .withColumn("reads", _whole_reads())
        .withColumn("a_statistic", _statistic(rate))
        .select(*columns)
    )
    return graph.with_edges(edges)


def a_stat_classes(graph: StringGraph, num_reads: int | None = None) -> DataFrame:
    """Per round: edges that count as unique, optional or required, and the genome estimate."""
    n = graph.orig_num_reads if num_reads is None else num_reads
    rates = _rates(graph, num_reads)
    rounds = F.array(*[
        F.struct(F.lit(i + 1).alias("round"), F.lit(rates[i]).alias("rate"),
                 F.lit(int(n / rates[i + 1]) if rates[i + 1] else 0).cast("long").alias("genome_len"))
        for i in range(BOOTSTRAP_ROUNDS)
    ])
    unique = _statistic(F.col("rate")) >= SINGLE_COPY_THRESHOLD
    return (
        _measured(graph).select("len", "reads", F.explode(rounds).alias("x"))
        .select("len", "reads", "x.*")
        .groupBy("round", "genome_len")
        .agg(
            F.count_if(unique).alias("unique_edges"),
            F.count_if(~unique & (F.col("reads") == 0)).alias("optional_edges"),
            F.count_if(~unique & (F.col("reads") != 0)).alias("required_edges"),
        )
        .select("round", "unique_edges", "optional_edges", "required_edges", "genome_len")
    )
