"""Every operator as a query ``(spark, sf_dir) -> DataFrame`` over the given tables.

Queries of one session and data folder share the written stage tables of one
``Assembly``; a query that runs first pays for the stages before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import functions as fn
from strandweave.operators import (
    circulation,
    collapse,
    containment,
    copy_number,
    degrees,
    euler,
    mapping,
    overlaps,
    reduction,
    render,
    string_graph,
)
from strandweave.plans import damage
from strandweave.plans.assembly import Assembly, assemble_files
from strandweave.plans.recipe import listing_key
from strandweave.session import cut_lineage, stage_path
from strandweave.sources import generators, reads, storage, tables

Query = Callable[[SparkSession, str], DataFrame]

_runs: dict[tuple[str, str], Assembly] = {}


def assembly_of(spark: SparkSession, sf_dir: str) -> Assembly:
    """The assembly of the reads derived from the tables as they are now; changed tables give another one."""
    key = (spark.sparkContext.applicationId, listing_key(spark, [f"{sf_dir}/{t}.parquet" for t in tables.READ_TABLES]))
    if key not in _runs:
        _runs[key] = Assembly(tables.sampled_reads(spark, sf_dir), tables.MIN_OVERLAP_LEN)
    return _runs[key]


def _recipe_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stages of the whole recipe, from a read file on."""
    path = f"{stage_path(spark, 'recipe')}.fasta"
    reads.write_reads(assembly_of(spark, sf_dir).reads, path)
    run = assemble_files(spark, [path], tables.MIN_OVERLAP_LEN, stage_path(spark, "recipe-store"))
    stages = {
        "reads": run.reads, "index_map": run.index_map, "kept_reads": run.kept_reads, "kept_overlaps": run.kept_overlaps,
        "reduced": run.reduced_rope.edges, "mapped": run.mapped_rope.edges, "collapsed": run.collapsed_rope.edges,
        "measured": run.measured_rope.edges, "circulated": run.circulated_rope.edges, "bidigraph": run.bidigraph_rope.edges,
    }
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows") for name, t in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def _rounded(graph: string_graph.StringGraph) -> DataFrame:
    return graph.edges.select(*[
        F.round(c, 6).alias(c) if c in ("mapped_read_count", "a_statistic") else F.col(c)
        for c in graph.edges.columns
    ])


def _scan_written(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{stage_path(spark, 'reads')}.{fmt}"
        reads.write_reads(assembly_of(spark, sf_dir).reads, path)
        return reads.read_reads(spark, path)
    return run


def _convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, base = assembly_of(spark, sf_dir).reads, stage_path(spark, "convert")
    reads.write_reads(source, f"{base}.fasta")
    reads.write_reads(source, f"{base}.fastq")
    reads.convert_reads(spark, [f"{base}.fasta", f"{base}.fastq"], f"{base}.parquet")
    return reads.read_reads(spark, f"{base}.parquet")


def _sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Slices from a quarter to three quarters of each read; codes and k-mers over all of it.
    beg, end = F.expr("length(seq) div 4").cast("int"), (F.expr("3 * length(seq) div 4").cast("int") - 1)
    # Each made once a read. The reverse complements of k-mers are the k-mers of the other strand, from its end.
    made = assembly_of(spark, sf_dir).reads.select(
        "read_id", "seq", fn.reverse_complement("seq").alias("rc"), F.transform(F.split("seq", ""), fn.base_code).alias("codes")
    ).select("*", fn.kmers("seq", 25).alias("words"), F.reverse(fn.kmers("rc", 25)).alias("rc_words"))
    return made.select(
        "read_id", F.length("seq").alias("len"), "rc",
        fn.slice_seq("seq", beg, end).alias("part"), fn.slice_seq("seq", beg, end, True).alias("rc_part"),
        fn.set_base("seq", end, F.lit("A")).alias("edited"),
        F.aggregate("codes", F.lit(0), lambda a, x: a + x).alias("code_sum"),
        F.array_join(F.transform("codes", lambda x: fn.base_letter(F.lit(3) - x)), "").alias("complement"),
        F.array_join(F.zip_with("words", "rc_words", fn.canonical_kmer), ",").alias("canonical"),
        F.size(F.filter(F.zip_with("words", "rc_words", fn.kmer_is_rc), lambda x: x)).alias("reversed_kmers"),
        fn.is_dna("seq").alias("valid"),
    )


def _numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return tables.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        fn.div_or_zero(F.col("l_discount"), F.col("l_tax")).alias("ratio"),
        fn.percent_of(F.col("l_discount"), F.col("l_tax")).alias("percent"),
        fn.ceil_div(F.col("l_quantity"), line).alias("lots"),
        fn.mod_or_zero(F.col("l_partkey"), line - 1).alias("remainder"),
    )


def _bare(overlap: DataFrame) -> DataFrame:
    return overlap.select(*overlaps.OVERLAP_COLUMNS)


def _dedup(a: Assembly) -> DataFrame:
    found = overlaps.overlap_dedup(overlaps.overlap_candidates(a.reads, a.min_len))
    return found.select("f", "g", (F.col("f_beg") > 0).alias("later"), "rc",
                        (F.col("f_end") - F.col("f_beg") + 1).alias("longest"))


def _built_bidigraph(a: Assembly) -> string_graph.StringGraph:
    return string_graph.build_bidigraph(a.kept_reads, a.kept_overlaps, a.num_kept_reads)


def _bidi_reduced(a: Assembly) -> DataFrame:
    graph = _built_bidigraph(a)
    graph = reduction.transitive_reduction(graph.with_edges(cut_lineage(graph.edges)))
    return graph.edges


def _starts(a: Assembly) -> DataFrame:
    if not a.ids_differ:
        return mapping.walk_starts(mapping.contained_overhangs(a.all_overlaps, a.index_map))
    # Placements are all that walks need of the overlaps, copies' included; the rest of the relation is not searched for.
    return mapping.walk_starts(mapping.nearest_containers(a.placements))


def _added(a: Assembly) -> DataFrame:
    starts = cut_lineage(_starts(a))
    return mapping.mapped_read_counts(starts, mapping.walk_back(starts, a.reduced_rope.edges, positions=a.walk_positions)).select(
        "edge_id", F.round("added", 6).alias("added"))


def _stats(graph: string_graph.StringGraph) -> DataFrame:
    return degrees.digraph_stats(graph).withColumn("mean_mapped_reads", F.round("mean_mapped_reads", 6))


def _rates(a: Assembly) -> DataFrame:
    rates = copy_number.arrival_rates(a.collapsed_rope)
    return rates.select(*[F.round(c, 9).alias(c) for c in rates.columns])


def _fasta_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tables.genome_blocks(tables.load(spark, sf_dir, "part").select("p_partkey"))
    header = spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(">genome").alias("line"))
    lines = blocks.select((F.col("block_no") + 1).alias("line_no"), F.col("bases").alias("line"))
    half = blocks.count() * tables.BLOCK_LEN // 2 + 7
    return generators.fasta_head(header.unionByName(lines), nbytes=half)


def _mapped_bidigraph(a: Assembly) -> string_graph.StringGraph:
    graph = string_graph.to_bidigraph(a.mapped)
    return graph.with_edges(cut_lineage(graph.edges))


def _bidi_collapsed(a: Assembly) -> DataFrame:
    graph = collapse.collapse_unbranched(_mapped_bidigraph(a))
    return _rounded(graph).drop("edge_id")


def _stored_overlaps(a: Assembly) -> DataFrame:
    path = stage_path(a.reads.sparkSession, "stored")
    storage.write_table(a.all_overlaps, path, storage.OVERLAP_SCHEMA)
    return storage.read_table(a.reads.sparkSession, path, storage.OVERLAP_SCHEMA)


def _stored_graph(graph: string_graph.StringGraph) -> DataFrame:
    path = stage_path(graph.edges.sparkSession, "stored")
    storage.write_graph(graph, path)
    return _rounded(storage.read_graph(graph.edges.sparkSession, path, graph.kind))


def _stored_kinds(a: Assembly) -> DataFrame:
    """Graphs of both kinds, read back without saying which is where, and the lines that print them."""
    rows = []
    for graph in (a.mapped, string_graph.to_bidigraph(a.measured)):
        path = stage_path(graph.edges.sparkSession, "stored")
        storage.write_graph(graph, path)
        found = storage.read_graph(graph.edges.sparkSession, path)
        counts = [t.agg(F.count("*").alias(n)) for n, t in (
            ("edges", found.edges), ("vertices", found.vertices), ("lines", render.print_graph(found)))]
        report = reduce(DataFrame.crossJoin, counts)  # three tables of one row
        rows.append(report.select(F.lit(found.kind).alias("kind"), "edges", "vertices", "lines",
                                  F.lit(found.orig_num_reads).cast("long").alias("reads")))
    return rows[0].unionByName(rows[1])


def _circulated_bounds(a: Assembly) -> DataFrame:
    return circulation.flow_bounds(a.circulated_rope.edges)


def _certificate(a: Assembly) -> DataFrame:
    """One row: that prices prove the flow of the assembly cheapest, and how much was proved."""
    edges, (flows, hub) = a.measured_rope.edges, a.flows
    broken = circulation.slack_violations(edges, flows, hub).agg(F.count("*").alias("slack_violations"))
    outside = circulation.circulation_violations(a.circulated_rope).agg(F.count("*").alias("flow_violations"))
    gap = circulation.duality(edges, flows, hub).select("gap")
    size = edges.agg(F.count("*").alias("edges"))
    return size.crossJoin(broken).crossJoin(outside).crossJoin(gap)


def _eulerian_circuits(a: Assembly) -> DataFrame:
    """Circuits of a graph whose edges each have a mirror image: one per component, every edge once."""
    graph = damage.mirrored(string_graph.to_bidigraph(a.measured_rope))
    cycle = cut_lineage(euler.eulerian_cycle(graph))
    broken = euler.cycle_violations(graph, cycle).count()
    return cycle.groupBy("circuit").agg(
        F.count("*").alias("steps"), F.countDistinct("edge_id").alias("edges_used"),
        F.max("step").alias("last_step")).withColumn("violations", F.lit(broken).cast("long"))


# Queries on the stages of one assembly.
STAGE_QUERIES: dict[str, Callable[[Assembly], DataFrame]] = {
    "sampled_reads": lambda a: a.reads,
    "sink_fasta": lambda a: reads.fasta_lines(a.reads),
    "sink_fastq": lambda a: reads.fastq_lines(a.reads),
    "kmer_occurrences": lambda a: overlaps.kmer_occurrences(a.reads, fn.seed_length(a.min_len)),
    "kmer_counts": lambda a: overlaps.kmer_counts(a.reads, fn.seed_length(a.min_len)),
    "seed_pair_counts": lambda a: overlaps.seed_pair_counts(a.reads, fn.seed_length(a.min_len)),
    "compute_overlaps": lambda a: _bare(a.all_overlaps),
    "overlap_dedup": _dedup,
    "overlap_violations": lambda a: overlaps.overlap_violations(a.reads, damage.overlaps(a.all_overlaps), a.min_len),
    "print_overlaps": lambda a: render.print_overlaps(a.all_overlaps),
    "contained_reads": lambda a: containment.contained_reads(a.all_overlaps),
    "old_to_new_indices": lambda a: a.index_map,
    "uncontained_reads": lambda a: a.kept_reads,
    "uncontained_overlaps": lambda a: _bare(a.kept_overlaps),
    "containment_summary": lambda a: a.containment_summary(),
    "build_digraph": lambda a: a.digraph.edges,
    "build_bidigraph": lambda a: _built_bidigraph(a).edges,
    "digraph_violations": lambda a: string_graph.digraph_violations(damage.digraph(a.digraph)),
    "bidigraph_violations": lambda a: string_graph.bidigraph_violations(damage.bidigraph(_built_bidigraph(a))),
    "transitive_edges": lambda a: reduction.transitive_edges(a.digraph.edges),
    "transitive_reduction": lambda a: a.reduced.edges,
    "bidi_transitive_reduction": _bidi_reduced,
    "vertex_degrees": lambda a: degrees.vertex_degrees(a.reduced_rope),
    "degree_histogram": lambda a: degrees.degree_histogram(a.reduced_rope),
    "digraph_stats": lambda a: _stats(a.mapped_rope),
    "bidigraph_stats": lambda a: degrees.bidigraph_stats(_built_bidigraph(a)),
    "mean_degree": lambda a: degrees.mean_degree(a.reduced_rope),
    "extract_edge_seqs": lambda a: string_graph.extract_edge_seqs(a.reduced),
    "extract_bidigraph_seqs": lambda a: string_graph.extract_edge_seqs(_built_bidigraph(a)),
    "contained_overhangs": lambda a: mapping.contained_overhangs(a.all_overlaps, a.index_map),
    "walk_starts": _starts,
    "walk_back": lambda a: mapping.walk_back(cut_lineage(_starts(a)), a.reduced_rope.edges, positions=a.walk_positions).withColumn("hits", F.col("hits").cast("long")),
    "mapped_read_counts": _added,
    "map_contained": lambda a: _rounded(a.mapped),
    "collapse_unbranched": lambda a: _rounded(a.collapsed),
    "collapsed_vertices": lambda a: a.collapsed_rope.vertices.select("v"),
    "smooth_rings": lambda a: collapse.smooth_rings(damage.ringed(a.mapped_rope)),
    "mapped_smooth_rings": lambda a: collapse.smooth_rings(a.mapped_rope, a.positions),
    "path_positions": lambda a: a.positions,
    "cut_ring_positions": lambda a: collapse.path_positions(cut_lineage(damage.ringed(a.mapped_rope).edges), cut_rings=True),
    "collapsed_pieces": lambda a: a.collapsed_rope.pieces,
    "components": lambda a: degrees.components(a.collapsed_rope.vertices, a.collapsed_rope.edges),
    "component_sizes": lambda a: degrees.component_sizes(a.collapsed_rope),
    "bootstrap_genome_len": lambda a: copy_number.bootstrap_genome_len(a.collapsed_rope),
    "arrival_rates": _rates,
    "a_statistics": lambda a: _rounded(a.measured),
    "a_stat_classes": lambda a: copy_number.a_stat_classes(a.collapsed_rope),
    "flow_bounds": lambda a: circulation.flow_bounds(a.measured_rope.edges),
    "digraph_to_bidigraph": lambda a: _rounded(string_graph.to_bidigraph(a.measured)),
    "bidigraph_to_digraph": lambda a: string_graph.to_digraph(string_graph.to_bidigraph(a.measured)).edges,
    "renumber_digraph": lambda a: string_graph.renumber(a.collapsed).edges.select(
        "edge_id", "twin_id", "v1", "v2", "seq"),
    "print_digraph": lambda a: render.print_digraph(a.mapped),
    "print_bidigraph": lambda a: render.print_bidigraph(string_graph.to_bidigraph(a.measured)),
    "graph_dot": lambda a: render.graph_dot(a.mapped),
    "bidigraph_dot": lambda a: render.graph_dot(string_graph.to_bidigraph(a.measured)),
    "graph_dot_seqs": lambda a: render.graph_dot(damage.traversed(a.mapped, 3), seqs=True),
    "bidigraph_dot_seqs": lambda a: render.graph_dot(damage.traversed(string_graph.to_bidigraph(a.measured), 3), seqs=True),
    "min_cost_circulation": lambda a: _rounded(a.circulated),
    "circulation_cost": lambda a: circulation.circulation_cost(a.circulated_rope),
    "circulation_slack": lambda a: circulation.slack_violations(*damage.priced(a.measured_rope)),
    "circulation_duality": lambda a: circulation.duality(*damage.priced(a.measured_rope)),
    "circulation_certificate": _certificate,
    "circulation_violations": lambda a: circulation.circulation_violations(damage.traversed(a.measured_rope, 4)),
    "balance_violations": lambda a: euler.balance_violations(damage.traversed(string_graph.to_bidigraph(a.measured_rope), 3)),
    "eulerian_cycle": lambda a: a.cycle,
    "cycle_violations": lambda a: euler.cycle_violations(
        damage.traversed(string_graph.to_bidigraph(a.measured_rope), 3), damage.listed_cycle(string_graph.to_bidigraph(a.measured_rope))),
    "eulerian_circuits": _eulerian_circuits,
    "contigs": lambda a: a.contigs,
    "bidi_collapse": _bidi_collapsed,
    "stored_overlaps": _stored_overlaps,
    "stored_digraph": lambda a: _stored_graph(a.mapped),
    "stored_bidigraph": lambda a: _stored_graph(string_graph.to_bidigraph(a.measured)),
    "circulated_flow_bounds": _circulated_bounds,
    "stored_graph_kinds": _stored_kinds,
}

TABLE_QUERIES: dict[str, Query] = {
    "scan_fasta": _scan_written("fasta"),
    "scan_fastq": _scan_written("fastq"),
    "convert_reads": _convert,
    "sequence_functions": _sequence_functions,
    "numeric_functions": _numeric_functions,
    "fasta_head": _fasta_head,
    "recipe_stages": _recipe_stages,
}


def _on_stage(query: Callable[[Assembly], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(assembly_of(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    return {**TABLE_QUERIES, **{name: _on_stage(q) for name, q in STAGE_QUERIES.items()}}
