"""Command line: one subcommand per stage, tables in and tables out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import build_session
from strandweave.functions import parse_bounded_int
from strandweave.operators import (
    circulation,
    collapse,
    containment,
    contigs,
    copy_number,
    degrees,
    euler,
    mapping,
    overlaps,
    reduction,
    render,
    string_graph,
)
from strandweave.operators.string_graph import StringGraph
from strandweave.plans.assembly import assemble_files
from strandweave.session import spread, write_stage
from strandweave.sources import reads as read_io
from strandweave.sources import storage

# Command names, their arguments in order, and option limits.
COMMANDS = {
    "convert-reads": ("inputs+", "output"),
    "compute-overlaps": ("reads", "overlaps"),
    "print-overlaps": ("overlaps", "output"),
    "remove-contained-reads": ("reads", "kept_reads", "overlaps", "kept_overlaps", "index_map"),
    "build-directed-string-graph": ("reads", "overlaps", "graph"),
    "build-bidirected-string-graph": ("reads", "overlaps", "graph"),
    "transitive-reduction": ("graph", "output"),
    "map-contained-reads": ("reads", "overlaps", "index_map", "graph", "output"),
    "collapse-unbranched-paths": ("graph", "output"),
    "calculate-A-statistics": ("graph", "output"),
    "min-cost-circulation": ("graph", "output"),
    "digraph-to-bidigraph": ("graph", "output"),
    "bidigraph-to-digraph": ("graph", "output"),
    "bidigraph-eulerian-cycle": ("graph", "output"),
    "extract-edge-seqs": ("graph", "output"),
    "print-string-graph": ("graph", "output"),
    "assemble": ("reads", "output"),
}
MIN_OVERLAP_LEN = 25
LEAST_MIN_OVERLAP_LEN = 4

GRAPH_STEPS = {
    "transitive-reduction": (None, reduction.transitive_reduction),
    "collapse-unbranched-paths": (None, collapse.collapse_unbranched),
    "calculate-A-statistics": ("digraph", copy_number.a_statistics),
    "min-cost-circulation": ("digraph", circulation.min_cost_circulation),
    "digraph-to-bidigraph": ("digraph", string_graph.to_bidigraph),
    "bidigraph-to-digraph": ("bidigraph", string_graph.to_digraph),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandweave")
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        cmd = sub.add_parser(name)
        for arg in args:
            cmd.add_argument(arg.rstrip("+"), nargs="+" if arg.endswith("+") else None)
        if name in ("compute-overlaps", "assemble"):
            cmd.add_argument("-l", "--min-overlap-len", default=str(MIN_OVERLAP_LEN))
            cmd.add_argument("-e", "--max-edits", default="0")
        if name == "print-string-graph":
            for flag in ("--dot", "--seqs", "--stats"):
                cmd.add_argument(flag, action="store_true")
    return top


def _overlap_table(spark: SparkSession, path: str) -> DataFrame:
    return storage.read_table(spark, path, storage.OVERLAP_SCHEMA)


def _print_graph(graph: StringGraph, args: argparse.Namespace) -> None:
    if args.dot:
        lines = render.graph_dot(graph, args.seqs).orderBy("part", "a", "b")
    elif args.stats:
        stats = degrees.digraph_stats if graph.kind == "digraph" else degrees.bidigraph_stats
        report = stats(graph).select(F.lit("graph").alias("part"), F.to_json(F.struct("*")).alias("line"))
        sizes = degrees.component_sizes(graph).select(F.lit("component").alias("part"), F.to_json(F.struct("*")).alias("line"))
        report.unionByName(sizes).write.json(args.output)
        return
    else:
        lines = render.print_graph(graph, args.seqs).orderBy("v", "edge_id")
    lines.select("line").write.text(args.output)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    name = args.command
    if name == "convert-reads":
        read_io.convert_reads(spark, args.inputs, args.output)
    elif name in ("compute-overlaps", "assemble"):
        min_len = parse_bounded_int(args.min_overlap_len, "--min-overlap-len", LEAST_MIN_OVERLAP_LEN)
        edits = parse_bounded_int(args.max_edits, "--max-edits", 0)
        source = read_io.read_reads(spark, args.reads)
        if name == "assemble":
            if edits:
                raise NotImplementedError("inexact overlaps are not supported")
            done = assemble_files(spark, [args.reads], min_len)
            storage.write_graph(done.bidigraph, f"{args.output}/graph")
            storage.write_table(done.cycle, f"{args.output}/cycle", storage.CYCLE_SCHEMA)
            lines = contigs.contig_fasta(done.contigs).orderBy("contig", "piece")
            lines.select("line").write.text(f"{args.output}/contigs.fasta")
        else:
            found = overlaps.compute_overlaps(spread(write_stage(source, "reads")), min_len, edits)
            storage.write_table(found, args.overlaps, storage.OVERLAP_SCHEMA)
    elif name == "print-overlaps":
        lines = render.print_overlaps(_overlap_table(spark, args.overlaps)).orderBy("f", "g", "type")
        lines.select("line").write.text(args.output)
    elif name == "remove-contained-reads":
        source, found = read_io.read_reads(spark, args.reads), _overlap_table(spark, args.overlaps)
        index = containment.old_to_new_indices(source, containment.contained_reads(found))
        storage.write_table(index, args.index_map, storage.INDEX_SCHEMA)
        index = storage.read_table(spark, args.index_map, storage.INDEX_SCHEMA)
        read_io.write_reads(containment.uncontained_reads(source, index), args.kept_reads)
        storage.write_table(containment.uncontained_overlaps(found, index), args.kept_overlaps, storage.OVERLAP_SCHEMA)
    elif name.startswith("build-"):
        build = string_graph.build_digraph if "-directed" in name else string_graph.build_bidigraph
        storage.write_graph(build(read_io.read_reads(spark, args.reads), _overlap_table(spark, args.overlaps)), args.graph)
    elif name == "map-contained-reads":
        index = storage.read_table(spark, args.index_map, storage.INDEX_SCHEMA)
        found = containment.with_lengths(_overlap_table(spark, args.overlaps), read_io.read_reads(spark, args.reads))
        graph = storage.read_graph(spark, args.graph, "digraph")
        storage.write_graph(mapping.map_contained(graph, found, index), args.output)
    elif name in GRAPH_STEPS:
        kind, step = GRAPH_STEPS[name]
        storage.write_graph(step(storage.read_graph(spark, args.graph, kind)), args.output)
    elif name == "bidigraph-eulerian-cycle":
        cycle = euler.eulerian_cycle(storage.read_graph(spark, args.graph, "bidigraph"))
        storage.write_table(cycle, args.output, storage.CYCLE_SCHEMA)
    elif name == "extract-edge-seqs":
        labels = string_graph.extract_edge_seqs(storage.read_graph(spark, args.graph))
        ranked = string_graph.number_seqs(labels)
        read_io.write_reads(ranked, args.output)
    else:
        _print_graph(storage.read_graph(spark, args.graph), args)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(sys.argv[1:] if argv is None else argv)
    try:
        run(spark or build_session(), args)
    except (ValueError, NotImplementedError) as problem:
        print(f"strandweave: {problem}", file=sys.stderr)
        return 1
    return 0
