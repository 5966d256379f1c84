"""Overlap, index-map, cycle and graph tables in Parquet with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.operators.string_graph import (
    StringGraph,
    bidigraph_violations,
    digraph_violations,
)

OVERLAP_SCHEMA = "f long, f_beg int, f_end int, g long, g_beg int, g_end int, rc boolean, f_len int, g_len int"
INDEX_SCHEMA = "old_id long, new_id long"
CYCLE_SCHEMA = "circuit long, step long, edge_id long, forward boolean"
VERTEX_SCHEMA = "v long, is_special boolean"
META_SCHEMA = "kind string, orig_num_reads long"
_ATTRIBUTES = (
    "mapped_read_count double, num_inner_vertices int, a_statistic double, "
    "traversal_count int, is_special boolean"
)
EDGE_SCHEMAS = {
    "digraph": f"edge_id long, twin_id long, v1 long, v2 long, seq string, {_ATTRIBUTES}",
    "bidigraph": "edge_id long, v1 long, v2 long, v1_outward boolean, v2_inward boolean, "
                 f"seq12 string, seq21 string, {_ATTRIBUTES}",
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in order and type."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in fields])


def write_table(df: DataFrame, path: str, schema: str) -> None:
    conform(df, schema).write.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _validate(graph: StringGraph, path: str) -> None:
    check = digraph_violations if graph.kind == "digraph" else bidigraph_violations
    broken = check(graph).take(1)
    if broken:
        raise ValueError(f"{path}: edge {broken[0]['edge_id']} breaks rule {broken[0]['rule']!r}")


def write_graph(graph: StringGraph, path: str, validate: bool = True) -> None:
    """Write ``edges``, ``vertices`` and ``meta`` below ``path``."""
    if validate:
        _validate(graph, path)
    write_table(graph.edges, f"{path}/edges", EDGE_SCHEMAS[graph.kind])
    write_table(graph.vertices, f"{path}/vertices", VERTEX_SCHEMA)
    meta = graph.edges.sparkSession.createDataFrame([(graph.kind, graph.orig_num_reads)], META_SCHEMA)
    meta.coalesce(1).write.parquet(f"{path}/meta")


def read_graph(spark: SparkSession, path: str, kind: str | None = None, validate: bool = True) -> StringGraph:
    """Graph of either kind; ``kind`` makes any other an error."""
    meta = read_table(spark, f"{path}/meta", META_SCHEMA).first()
    if kind is not None and meta["kind"] != kind:
        raise ValueError(f"{path} holds a {meta['kind']}, not a {kind}")
    graph = StringGraph(
        meta["kind"],
        read_table(spark, f"{path}/vertices", VERTEX_SCHEMA),
        read_table(spark, f"{path}/edges", EDGE_SCHEMAS[meta["kind"]]),
        meta["orig_num_reads"],
    )
    if validate:
        _validate(graph, path)
    return graph
