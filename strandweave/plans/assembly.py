"""The whole assembly: reads in, ordered cycle out, one written table per stage.

Stages run on first use and are written to the shared folder, so a lost executor costs
a stage's tasks and not the run, and every later stage starts from a file source with
column pruning and size statistics.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import (
    circulation,
    collapse,
    containment,
    contigs,
    copies,
    copy_number,
    euler,
    mapping,
    overlaps,
    reduction,
    string_graph,
)
from strandweave.operators.string_graph import StringGraph
from strandweave.plans.recipe import Store, listing_key
from strandweave.session import cut_lineage, dropped_rounds, spread, write_stage
from strandweave.sources.reads import read_reads

log = logging.getLogger("strandweave")


# Stages that do not depend on the overlap length.
_OF_READS_ALONE = ("reads", "read_groups", "copies")


class Assembly:
    """All stages for one read set ``(read_id, seq)`` and minimum overlap length.

    With a ``store`` finished stages are found again by later applications; see ``recipe``.
    """

    def __init__(self, reads: DataFrame, min_len: int = 25, store: Store | None = None):
        self._source = reads
        self.min_len = min_len
        self.store = store
        self.seconds: dict[str, float] = {}

    def _stage(self, name: str, build: Callable[[], DataFrame], *inputs: str) -> DataFrame:
        """A written stage; the stages it needs run first, each on its own clock."""
        params = {} if name in _OF_READS_ALONE else {"min_len": self.min_len}
        found = self.store.find(name, params) if self.store else None
        if found is not None:
            return found
        for needed in inputs:
            getattr(self, needed)
        spark = self._source.sparkSession
        began = time.monotonic()
        with dropped_rounds(spark):
            df = build()
            table = self.store.keep(name, params, df) if self.store else write_stage(df, name)
        self.seconds[name] = round(time.monotonic() - began, 3)
        log.info("stage %s: %.1f s", name, self.seconds[name])
        return table

    @cached_property
    def reads(self) -> DataFrame:
        return spread(self._stage("reads", lambda: self._source))

    @cached_property
    def ids_differ(self) -> bool:
        """Whether every read has an id of its own. Where several rows share one, the rows of each count."""
        ids = self.reads.groupBy("read_id").agg(F.count("*").alias("n"))
        return ids.where("n > 1 OR read_id IS NULL").isEmpty()

    @cached_property
    def read_groups(self) -> DataFrame:
        return spread(self._stage("read_groups", lambda: copies.read_groups(self.reads), "reads"))

    @cached_property
    def copies(self) -> DataFrame:
        return self._stage("copies", lambda: copies.copies_of(self.reads, self.read_groups), "read_groups")

    @property
    def distinct_reads(self) -> DataFrame:
        return self.read_groups.select("read_id", "seq")

    @cached_property
    def containments(self) -> DataFrame:
        """Overlaps in which one of two distinct reads lies inside the other."""
        return self._stage("containments", lambda: overlaps.containing_overlaps(self.distinct_reads, self.min_len), "read_groups")

    @cached_property
    def overlaps(self) -> DataFrame:
        """Overlaps between distinct reads that lie in no other; with ``containments`` all that the assembly needs."""
        def build() -> DataFrame:
            outer = self.distinct_reads.join(containment.contained_reads(self.containments), "read_id", "left_anti")
            return overlaps.compute_overlaps(cut_lineage(outer), self.min_len)
        return self._stage("overlaps", build, "containments")

    @cached_property
    def distinct_overlaps(self) -> DataFrame:
        """All overlaps between distinct reads, for listings."""
        return self._stage("distinct_overlaps", lambda: overlaps.compute_overlaps(self.distinct_reads, self.min_len), "read_groups")

    @cached_property
    def all_overlaps(self) -> DataFrame:
        """The complete overlap relation, pairs of copies included: only those with a copy are searched for again."""
        if self.copies.isEmpty():
            return self.distinct_overlaps
        of_copies = self._stage("copy_overlaps", lambda: overlaps.compute_overlaps(
            self.reads, self.min_len, touching=self.copies), "copies", "distinct_overlaps")
        return self.distinct_overlaps.unionByName(of_copies)

    @cached_property
    def index_map(self) -> DataFrame:
        def build() -> DataFrame:
            contained = containment.contained_reads(self.containments).union(self.copies.select("read_id"))
            return containment.old_to_new_indices(self.reads, contained)
        return self._stage("index_map", build, "copies", "containments")

    @cached_property
    def kept_reads(self) -> DataFrame:
        return self._stage("kept_reads", lambda: containment.uncontained_reads(self.reads, self.index_map), "index_map")

    @cached_property
    def num_kept_reads(self) -> int:
        return self.kept_reads.count()

    @cached_property
    def kept_overlaps(self) -> DataFrame:
        return self._stage("kept_overlaps", lambda: containment.uncontained_overlaps(self.overlaps, self.index_map),
                           "index_map", "overlaps")

    @cached_property
    def skeleton(self) -> DataFrame:
        return self._stage("skeleton", lambda: string_graph.edge_skeleton(self.kept_overlaps), "kept_overlaps")

    @property
    def digraph(self) -> StringGraph:
        """The unreduced graph with labels; the assembly itself goes on from the skeleton."""
        if self.ids_differ:  # a label is one slice of one read: it needs no pieces
            return string_graph.labelled_digraph(self.skeleton, self.kept_reads, self.num_kept_reads)
        return string_graph.with_text(self._graph(self.skeleton, self._labels(self.skeleton)))

    def _labels(self, skeleton: DataFrame) -> DataFrame:
        """One piece per edge, cut from its read."""
        return string_graph.attach_labels(skeleton, self.kept_reads).select(
            "edge_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("offset"), "seq")

    def _graph(self, skeleton: DataFrame, pieces: DataFrame) -> StringGraph:
        edges = skeleton.select("edge_id", "twin_id", "v1", "v2", F.col("len").cast("long").alias("len"),
                                *string_graph.default_attributes())
        return StringGraph("digraph", string_graph.read_vertices(self.kept_reads), edges, self.num_kept_reads, pieces)

    @cached_property
    def reduced_rope(self) -> StringGraph:
        """The reduced graph: edges with lengths, and the text of their labels as a table of its own."""
        kept = self._stage("reduced", lambda: reduction.reduced_skeleton(self.skeleton), "skeleton")
        return self._graph(kept, self._stage("labels", lambda: self._labels(kept), "kept_reads"))

    @cached_property
    def positions(self) -> DataFrame:
        """Where edges lie on the unbranched paths of the reduced graph; for the walks and the collapse."""
        return self._stage("positions", lambda: collapse.path_positions(self.reduced_rope.edges), "reduced_rope")

    @cached_property
    def placements(self) -> DataFrame:
        """Where contained reads lie in uncontained ones, copies included."""
        def build() -> DataFrame:
            single = mapping.containers(self.containments, self.index_map)
            return single.unionByName(copies.copy_placements(self.copies, single, self.index_map))
        return self._stage("placements", build, "index_map")

    @cached_property
    def walk_positions(self) -> DataFrame | None:
        """Positions for backward walks, which need rings opened; without any, those of the collapse serve them too."""
        rings = not self.positions.where(F.col("head").isNull()).isEmpty()
        return None if rings else self.positions

    @cached_property
    def mapped_rope(self) -> StringGraph:
        def build() -> DataFrame:
            return mapping.map_placements(self.reduced_rope, self.placements, self.walk_positions).edges
        edges = self._stage("mapped", build, "positions", "placements")
        return self.reduced_rope.with_edges(edges)

    @cached_property
    def collapsed_rope(self) -> StringGraph:
        source = self.mapped_rope
        graph = collapse.collapse_unbranched(source, self.positions)
        return graph.with_edges(self._stage("collapsed", lambda: graph.edges),
                                self._stage("collapsed_vertices", lambda: graph.vertices))

    @cached_property
    def measured_rope(self) -> StringGraph:
        edges = self._stage("measured", lambda: copy_number.a_statistics(self.collapsed_rope).edges, "collapsed_rope")
        return self.collapsed_rope.with_edges(edges)

    @cached_property
    def flows(self) -> tuple[DataFrame, DataFrame]:
        """Flow of every edge, and hub flow and price of every vertex; see ``solve_circulation``."""
        # Both tables come from one solution, so they are kept as one.
        def build() -> DataFrame:
            flows, hub = circulation.solve_circulation(self.measured_rope)
            return flows.select("edge_id", "flow").unionByName(hub, allowMissingColumns=True)
        solved = self._stage("solved", build, "measured_rope")
        return (solved.where("edge_id IS NOT NULL").select("edge_id", "flow"),
                solved.where("v IS NOT NULL").select("v", "fill", "spill", "price"))

    @cached_property
    def circulated_rope(self) -> StringGraph:
        flows, hub = self.flows
        graph = circulation.with_flows(self.measured_rope, flows, hub)
        return graph.with_edges(self._stage("circulated", lambda: graph.edges),
                                self._stage("circulated_vertices", lambda: graph.vertices))

    @cached_property
    def bidigraph_rope(self) -> StringGraph:
        graph = string_graph.to_bidigraph(self.circulated_rope)
        return graph.with_edges(self._stage("bidigraph", lambda: graph.edges),
                                self._stage("bidigraph_vertices", lambda: graph.vertices))

    # The same graphs with their labels joined to text, for listings and files.
    reduced = property(lambda self: string_graph.with_text(self.reduced_rope))
    mapped = property(lambda self: string_graph.with_text(self.mapped_rope))
    collapsed = property(lambda self: string_graph.with_text(self.collapsed_rope))
    measured = property(lambda self: string_graph.with_text(self.measured_rope))
    circulated = property(lambda self: string_graph.with_text(self.circulated_rope))
    bidigraph = property(lambda self: string_graph.with_text(self.bidigraph_rope))

    @cached_property
    def cycle(self) -> DataFrame:
        return self._stage("cycle", lambda: euler.eulerian_cycle(self.bidigraph_rope), "bidigraph_rope")

    @cached_property
    def contigs(self) -> DataFrame:
        """Contig texts in pieces; see ``contigs.contig_pieces``."""
        return self._stage("contigs", lambda: contigs.contig_pieces(self.bidigraph_rope, self.cycle, self.kept_reads), "cycle", "kept_reads")

    def containment_summary(self) -> DataFrame:
        return containment.containment_summary(
            self.index_map, self.all_overlaps.select(F.lit(1)), self.kept_overlaps.select(F.lit(1)))


def assemble(reads: DataFrame, min_len: int = 25, store: Store | None = None) -> Assembly:
    """Run every stage up to the contigs."""
    run = Assembly(reads, min_len, store)
    _ = run.contigs
    return run


def assemble_files(spark: SparkSession, paths: Sequence[str], min_len: int = 25, root: str | None = None) -> Assembly:
    """The whole recipe, read files to contigs; stages that an earlier run finished are read again."""
    return assemble(read_reads(spark, list(paths)), min_len, Store(spark, listing_key(spark, paths), root))
