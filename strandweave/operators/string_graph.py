"""Directed and bidirected string graphs as vertex and edge tables.

Directed vertex ``2 * read`` is the beginning (B) and ``2 * read + 1`` the end (E) of a
read. Every edge has a twin running the other way on the opposite strand; the pair
shares an overlap and carries each other's id, so twins are found by id and stay
right where parallel edges exist.

A graph's labels are either text columns of its edges or *ropes*: a side table of pieces of bounded
size, and lengths on the edges. Stages work on ropes, so no row ever holds the text of a
path; ``with_text`` joins the pieces where text is what is asked for.

The label of an edge is a slice of the read it leads to. Edges therefore start as a
*skeleton* of ids, lengths and slice bounds. Text joins in only where it is needed, after the
reduction has removed most edges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import slice_seq
from strandweave.operators.containment import is_proper, with_lengths
from strandweave.operators.ranking import dense_ids, dense_order

ATTRIBUTES = (
    "mapped_read_count", "num_inner_vertices", "a_statistic", "traversal_count", "is_special",
)
DIGRAPH_COLUMNS = ("edge_id", "twin_id", "v1", "v2", "seq", *ATTRIBUTES)
BIDIGRAPH_COLUMNS = (
    "edge_id", "v1", "v2", "v1_outward", "v2_inward", "seq12", "seq21", *ATTRIBUTES,
)
SLICE = ("beg", "end", "flip")


@dataclass(frozen=True)
class StringGraph:
    """``kind`` is "digraph" or "bidigraph"; ``vertices`` is ``(v, is_special)``.

    With ``pieces``, ``(edge_id, part, offset, seq)``, edges carry ``len`` (``len12``, ``len21``) in place of text;
    ``part`` is 1 for the second label of a bidirected edge.
    """

    kind: str
    vertices: DataFrame
    edges: DataFrame
    orig_num_reads: int
    pieces: DataFrame | None = None

    def with_edges(self, edges: DataFrame, vertices: DataFrame | None = None) -> StringGraph:
        return replace(self, edges=edges, vertices=self.vertices if vertices is None else vertices)


# Bases of a label that one task joins at first, about.
TEXT_CHUNK = 1 << 20


def as_rope(graph: StringGraph) -> StringGraph:
    """The graph with one piece per label."""
    if graph.pieces is not None:
        return graph
    names = ["seq"] if graph.kind == "digraph" else ["seq12", "seq21"]
    pieces = graph.edges.select("edge_id", F.posexplode(F.array(*names)).alias("part", "seq")).select(
        "edge_id", "part", F.lit(0).cast("long").alias("offset"), "seq")
    edges = graph.edges.select(*[
        F.length(c).cast("long").alias(c.replace("seq", "len")) if c in names else F.col(c) for c in graph.edges.columns])
    return replace(graph, edges=edges, pieces=pieces)


def label_texts(pieces: DataFrame) -> DataFrame:
    """``(edge_id, part, seq)``: whole labels, for readers that want them as one value each.

    Pieces of a long label are first joined by many tasks, chunk by chunk.
    """
    def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(order, "seq")))
        return rows.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.array_join(F.col("p.seq"), "").alias("seq"))

    chunks = joined(pieces.withColumn("chunk", F.floor(F.col("offset") / TEXT_CHUNK)), ["edge_id", "part", "chunk"], "offset")
    return joined(chunks, ["edge_id", "part"], "chunk")


def with_text(graph: StringGraph) -> StringGraph:
    """The graph with its labels as text columns; a label without pieces is empty."""
    if graph.pieces is None:
        return graph
    names = {"len": "seq"} if graph.kind == "digraph" else {"len12": "seq12", "len21": "seq21"}
    texts = label_texts(graph.pieces)
    wide = texts.groupBy("edge_id").agg(*[
        F.max(F.when(F.col("part") == k, F.col("seq"))).alias(c) for k, c in enumerate(names.values())])
    edges = graph.edges.join(wide, "edge_id", "left").select(*[
        F.coalesce(names[c], F.lit("")).alias(names[c]) if c in names else F.col(c) for c in graph.edges.columns])
    return replace(graph, edges=edges, pieces=None)


def edge_len(edges: DataFrame) -> Column:
    return F.col("len") if "len" in edges.columns else F.length("seq")


def default_attributes() -> list[Column]:
    """Attributes of a fresh edge."""
    return [
        F.lit(1.0).alias("mapped_read_count"),
        F.lit(0).alias("num_inner_vertices"),
        F.lit(0.0).alias("a_statistic"),
        F.lit(0).alias("traversal_count"),
        F.lit(False).alias("is_special"),
    ]


def read_vertices(reads: DataFrame, per_read: int = 2) -> DataFrame:
    """Vertices of a graph over densely numbered reads: two per read, or one if bidirected."""
    if per_read == 1:
        return reads.select(F.col("read_id").alias("v"), F.lit(False).alias("is_special"))
    return reads.select(
        F.explode(F.array(F.col("read_id") * 2, F.col("read_id") * 2 + 1)).alias("v"),
        F.lit(False).alias("is_special"),
    )


def edge_skeleton(overlaps: DataFrame) -> DataFrame:
    """Two directed edges per proper overlap, without label text.

    ``(edge_id, twin_id, v1, v2, len, beg, end, flip)``: the label is the slice
    ``beg..end`` of the read behind v2, reverse-complemented where ``flip``.
    """
    numbered = dense_order(
        overlaps.where(is_proper()).withColumn("later", F.col("f_beg") > 0),
        ["f", "g", "later", "rc"], "overlap_no",
    )
    f, g, rc = F.col("f") * 2, F.col("g") * 2, F.col("rc")
    later = F.col("later")
    f_end = later.cast("int")              # f is left through E if the overlap starts later in f
    g_end = (later != rc).cast("int")      # g is reached at E unless that strand is reversed
    head, tail = F.struct(F.lit(0).alias("beg"), (F.col("g_beg") - 1).alias("end"), F.lit(True).alias("flip")), \
        F.struct((F.col("g_end") + 1).alias("beg"), (F.col("g_len") - 1).alias("end"), F.lit(False).alias("flip"))
    to_g = F.when(g_end == 1, tail).otherwise(head)
    to_f = F.when(
        later,
        F.struct(F.lit(0).alias("beg"), (F.col("f_beg") - 1).alias("end"), F.lit(True).alias("flip")),
    ).otherwise(
        F.struct((F.col("f_end") + 1).alias("beg"), (F.col("f_len") - 1).alias("end"), F.lit(False).alias("flip"))
    )
    even, odd = F.col("overlap_no") * 2, F.col("overlap_no") * 2 + 1
    pair = F.array(
        F.struct(even.alias("edge_id"), odd.alias("twin_id"), (f + f_end).alias("v1"),
                 (g + g_end).alias("v2"), to_g.alias("part")),
        F.struct(odd.alias("edge_id"), even.alias("twin_id"), (g + 1 - g_end).alias("v1"),
                 (f + 1 - f_end).alias("v2"), to_f.alias("part")),
    )
    edge = numbered.select(F.explode(pair).alias("e")).select("e.*")
    return edge.select(
        "edge_id", "twin_id", "v1", "v2",
        (F.col("part.end") - F.col("part.beg") + 1).alias("len"),
        "part.beg", "part.end", "part.flip",
    )


def attach_labels(skeleton: DataFrame, reads: DataFrame) -> DataFrame:
    """Replace the slice bounds of each edge by the label text: one join on the target read."""
    source = reads.select(F.col("read_id").alias("_read"), F.col("seq").alias("_seq"))
    keep = [c for c in skeleton.columns if c not in SLICE]
    return (
        skeleton.withColumn("_read", F.floor(F.col("v2") / 2))
        .join(source, "_read")
        .select(*keep, slice_seq("_seq", F.col("beg"), F.col("end"), F.col("flip")).alias("seq"))
    )


def build_digraph(reads: DataFrame, overlaps: DataFrame, num_reads: int | None = None) -> StringGraph:
    """Directed string graph of densely numbered uncontained reads."""
    return labelled_digraph(edge_skeleton(with_lengths(overlaps, reads)), reads, num_reads)


def labelled_digraph(skeleton: DataFrame, reads: DataFrame, num_reads: int | None = None) -> StringGraph:
    """The graph of a skeleton, with text."""
    edges = attach_labels(skeleton, reads).select(
        "edge_id", "twin_id", "v1", "v2", "seq", *default_attributes()
    )
    n = reads.count() if num_reads is None else num_reads
    return StringGraph("digraph", read_vertices(reads), edges, n)


def build_bidigraph(reads: DataFrame, overlaps: DataFrame, num_reads: int | None = None) -> StringGraph:
    """Bidirected string graph: one vertex per read, one edge per proper overlap."""
    directed = attach_labels(edge_skeleton(with_lengths(overlaps, reads)), reads)
    # The two labels of a pair are a grouping on the pair number; both rows are fixed in size.
    pair = F.shiftright("edge_id", 1)
    even = F.col("edge_id") % 2 == 0
    edges = (
        directed.groupBy(pair.alias("edge_id"))
        .agg(
            F.max(F.when(even, F.col("v1"))).alias("d1"),
            F.max(F.when(even, F.col("v2"))).alias("d2"),
            F.max(F.when(even, F.col("seq"))).alias("seq12"),
            F.max(F.when(~even, F.col("seq"))).alias("seq21"),
        )
        .select(
            "edge_id",
            F.shiftright("d1", 1).alias("v1"),
            F.shiftright("d2", 1).alias("v2"),
            (F.col("d1") % 2 == 1).alias("v1_outward"),
            (F.col("d2") % 2 == 1).alias("v2_inward"),
            "seq12", "seq21", *default_attributes(),
        )
    )
    n = reads.count() if num_reads is None else num_reads
    return StringGraph("bidigraph", read_vertices(reads, 1), edges, n)


def to_bidigraph(graph: StringGraph) -> StringGraph:
    """One bidirected edge per twin pair.

    Mapped counts, A-statistics and inner counts are averaged, traversal counts added.
    An edge that is its own twin stands for itself once.
    """
    r1, r2 = F.shiftright("v1", 1), F.shiftright("v2", 1)
    leads = (
        F.when(r1 != r2, F.col("v1") < F.col("v2"))
        .when(F.col("v1") == F.col("v2"), F.col("v1") % 2 == 1)
        .otherwise(F.col("edge_id") <= F.col("twin_id"))
    )
    label = "seq" if graph.pieces is None else "len"
    first = graph.edges.where(leads).alias("a")
    twin = graph.edges.select(
        F.col("edge_id").alias("twin_id"), F.col(label).alias("t_label"),
        *[F.col(c).alias(f"t_{c}") for c in ATTRIBUTES[:4]],
    )
    alone = F.col("edge_id") == F.col("twin_id")

    def both(name: str) -> Column:
        return F.col(name) + F.col(f"t_{name}")

    edges = first.join(twin, "twin_id").select(
        "edge_id",
        r1.alias("v1"),
        r2.alias("v2"),
        (F.col("v1") % 2 == 1).alias("v1_outward"),
        (F.col("v2") % 2 == 1).alias("v2_inward"),
        F.col(label).alias(f"{label}12"),
        F.col("t_label").alias(f"{label}21"),
        (both("mapped_read_count") / 2).alias("mapped_read_count"),
        F.floor(both("num_inner_vertices") / 2).cast("int").alias("num_inner_vertices"),
        (both("a_statistic") / 2).alias("a_statistic"),
        F.when(alone, F.col("traversal_count")).otherwise(both("traversal_count")).alias("traversal_count"),
        "is_special",
    )
    vertices = graph.vertices.where(F.col("v") % 2 == 0).select(
        F.shiftright("v", 1).alias("v"), "is_special"
    )
    pieces = None
    if graph.pieces is not None:
        sides = F.array(F.struct(F.col("edge_id").alias("directed"), F.lit(0).alias("part")),
                        F.struct(F.col("twin_id").alias("directed"), F.lit(1).alias("part")))
        owners = graph.edges.where(leads).select("edge_id", F.explode(sides).alias("s")).select("edge_id", "s.*")
        pieces = graph.pieces.select(F.col("edge_id").alias("directed"), "offset", "seq").join(owners, "directed").select(
            "edge_id", "part", "offset", "seq")
    return StringGraph("bidigraph", vertices, edges, graph.orig_num_reads, pieces)


def to_digraph(graph: StringGraph, keep_attributes: bool = False) -> StringGraph:
    """Two directed edges per bidirected edge, ids ``2 e`` and ``2 e + 1``.

    Attributes restart at their defaults, or with ``keep_attributes`` are such that
    ``to_bidigraph`` gives them back: traversals are shared between the two, the rest repeated.
    """
    v1, v2 = F.col("v1") * 2, F.col("v2") * 2
    out1, in2 = F.col("v1_outward").cast("int"), F.col("v2_inward").cast("int")
    even, odd = F.col("edge_id") * 2, F.col("edge_id") * 2 + 1
    label = "seq" if graph.pieces is None else "len"
    pair = F.array(
        F.struct(even.alias("edge_id"), odd.alias("twin_id"), (v1 + out1).alias("v1"),
                 (v2 + in2).alias("v2"), F.col(f"{label}12").alias(label)),
        F.struct(odd.alias("edge_id"), even.alias("twin_id"), (v2 + 1 - in2).alias("v1"),
                 (v1 + 1 - out1).alias("v2"), F.col(f"{label}21").alias(label)),
    )
    edges = graph.edges.select(F.explode(pair).alias("e"), *(ATTRIBUTES if keep_attributes else ()))
    if keep_attributes:
        half = F.floor(F.col("traversal_count") / 2).cast("int")
        share = F.when(F.col("e.edge_id") % 2 == 0, F.col("traversal_count") - half).otherwise(half)
        edges = edges.select("e.*", *[share.alias(c) if c == "traversal_count" else c for c in ATTRIBUTES])
    else:
        edges = edges.select("e.*", *default_attributes())
    vertices = graph.vertices.select(
        F.explode(F.array(F.col("v") * 2, F.col("v") * 2 + 1)).alias("v"), "is_special"
    )
    pieces = None if graph.pieces is None else graph.pieces.select(
        (F.col("edge_id") * 2 + F.col("part")).alias("edge_id"), F.lit(0).alias("part"), "offset", "seq")
    return StringGraph("digraph", vertices, edges, graph.orig_num_reads, pieces)


def extract_edge_seqs(graph: StringGraph) -> DataFrame:
    """``(edge_id, part, seq)``: one label per directed edge, two per bidirected edge."""
    graph = with_text(graph)
    if graph.kind == "digraph":
        return graph.edges.select("edge_id", F.lit(0).alias("part"), "seq")
    return graph.edges.select("edge_id", F.posexplode(F.array("seq12", "seq21")).alias("part", "seq"))


def number_seqs(labels: DataFrame) -> DataFrame:
    """``(read_id, seq)``: labels numbered in edge order, as a read set."""
    return dense_order(labels, ["edge_id", "part"], "read_id").select("read_id", "seq")


def renumber(graph: StringGraph) -> StringGraph:
    """Directed graph with dense vertex and edge numbers in the old order."""
    v = dense_ids(graph.vertices, "v", "new_v")
    e = dense_ids(graph.edges.select("edge_id"), "edge_id", "new_edge")
    rest = [c for c in graph.edges.columns if c not in ("edge_id", "twin_id", "v1", "v2")]
    edges = (
        graph.edges.join(v.select(F.col("v").alias("v1"), F.col("new_v").alias("n1")), "v1")
        .join(v.select(F.col("v").alias("v2"), F.col("new_v").alias("n2")), "v2")
        .join(e.select("edge_id", F.col("new_edge").alias("ne")), "edge_id")
        .join(e.select(F.col("edge_id").alias("twin_id"), F.col("new_edge").alias("nt")), "twin_id")
        .select(F.col("ne").alias("edge_id"), F.col("nt").alias("twin_id"),
                F.col("n1").alias("v1"), F.col("n2").alias("v2"), *rest)
    )
    done = graph.with_edges(edges, v.select(F.col("new_v").alias("v"), "is_special"))
    if graph.pieces is None:
        return done
    return replace(done, pieces=graph.pieces.join(e, "edge_id").select(F.col("new_edge").alias("edge_id"), "part", "offset", "seq"))


def digraph_violations(graph: StringGraph) -> DataFrame:
    """``(edge_id, rule)`` for edges with a foreign endpoint or without their twin."""
    e = graph.edges.select("edge_id", "twin_id", "v1", "v2")
    t = e.select(
        F.col("edge_id").alias("twin_id"), F.col("twin_id").alias("back"),
        F.col("v1").alias("t1"), F.col("v2").alias("t2"),
    )
    v = graph.vertices.select("v")
    rule = (
        F.when(F.col("h1").isNull() | F.col("h2").isNull(), "endpoint")
        .when(F.col("back").isNull() | (F.col("back") != F.col("edge_id")), "twin id")
        .when((F.col("t1") != F.col("v2").bitwiseXOR(F.lit(1)))
              | (F.col("t2") != F.col("v1").bitwiseXOR(F.lit(1))), "twin ends")
    )
    return (
        e.join(v.select(F.col("v").alias("v1"), F.lit(True).alias("h1")), "v1", "left")
        .join(v.select(F.col("v").alias("v2"), F.lit(True).alias("h2")), "v2", "left")
        .join(t, "twin_id", "left")
        .select("edge_id", rule.alias("rule"))
        .where(F.col("rule").isNotNull())
    )


def bidigraph_violations(graph: StringGraph) -> DataFrame:
    """``(edge_id, rule)`` for bidirected edges with a foreign endpoint or a missing label."""
    v = graph.vertices.select("v")
    rule = (
        F.when(F.col("h1").isNull() | F.col("h2").isNull(), "endpoint")
        .when(F.col("seq12").isNull() | F.col("seq21").isNull(), "label")
    )
    return (
        graph.edges.select("edge_id", "v1", "v2", "seq12", "seq21")
        .join(v.select(F.col("v").alias("v1"), F.lit(True).alias("h1")), "v1", "left")
        .join(v.select(F.col("v").alias("v2"), F.lit(True).alias("h2")), "v2", "left")
        .select("edge_id", rule.alias("rule"))
        .where(F.col("rule").isNotNull())
    )
