"""Text forms of overlaps and graphs, one row per line.

Order columns are part of the result, so that ``orderBy`` and a text sink give the
listing; nothing is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.string_graph import StringGraph

# Line formats of the listings.
OVERLAP_FORMAT = "Overlap { Read %d: [%d, %d], Read %d: [%d, %d], rc = %d }"
DIGRAPH_FORMAT = "%d.%s -> %d.%s"
BIDIGRAPH_FORMAT = "%d %s---------%s %d"
ATTRIBUTE_NAMES = (
    "_mapped_read_count", "_num_inner_vertices", "_A_statistic", "_traversal_count", "_is_special",
)
DOT_HEAD = (
    "digraph {",
    '\tnode [shape=circle fontname="Arial"]',
    '\tedge [fontname="Courier new bold" fontsize=11]',
)
DOT_DIGRAPH_STYLE = "\tnode [style=filled];"
DOT_TAIL = "}"
DOT_CURVE = 2.0


def short_number(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    # Six digits in exponent form: rounding may carry, so the exponent is read off afterwards.
    digits = F.format_string("%.5e", x)
    exponent = F.substring_index(digits, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(digits, "e", 1), r"\.?0+$", "")
    sign = F.when(exponent < 0, "-").otherwise("+")
    long_form = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    fixed = F.substring_index(digits, "e", 1).cast("decimal(20,10)") * F.pow(F.lit(10.0), exponent).cast("decimal(18,6)")
    plain = F.regexp_replace(fixed.cast("decimal(30,10)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= 6), long_form).otherwise(plain)


def print_overlaps(overlaps: DataFrame) -> DataFrame:
    """``(f, g, type, line)`` with read numbers from 1."""
    return overlaps.select(
        "f", "g", ((F.col("f_beg") > 0).cast("int") * 2 + F.col("rc").cast("int")).alias("type"),
        F.format_string(OVERLAP_FORMAT, F.col("f") + 1, F.col("f_beg"), F.col("f_end"), F.col("g") + 1,
                        F.col("g_beg"), F.col("g_end"), F.col("rc").cast("int")).alias("line"),
    )


def _side(v: Column) -> Column:
    return F.when(v % 2 == 1, "E").otherwise("B")


def _attributes() -> Column:
    values = [
        short_number(F.col("mapped_read_count")),
        F.col("num_inner_vertices").cast("string"),
        short_number(F.col("a_statistic")),
        F.col("traversal_count").cast("string"),
        F.col("is_special").cast("int").cast("string"),
    ]
    return F.concat_ws("\t", *[F.concat(F.lit(f"{n}="), v) for n, v in zip(ATTRIBUTE_NAMES, values)])


def _label(seq: str, seqs: bool) -> Column:
    return F.col(seq) if seqs else F.length(seq).cast("string")


def print_digraph(graph: StringGraph, seqs: bool = False) -> DataFrame:
    """``(v, edge_id, line)``: one line per edge, listed under its tail."""
    v1, v2 = F.col("v1"), F.col("v2")
    ends = F.format_string(DIGRAPH_FORMAT, F.shiftright(v1, 1) + 1, _side(v1), F.shiftright(v2, 1) + 1, _side(v2))
    return graph.edges.select(
        v1.alias("v"), "edge_id", F.concat_ws("\t", ends, _attributes(), _label("seq", seqs)).alias("line")
    )


def print_bidigraph(graph: StringGraph, seqs: bool = False) -> DataFrame:
    """``(v, edge_id, place, line)``: one line per edge under each of its two vertices.

    Seen from its second vertex an edge is turned round: vertices swap and both heads flip.
    """
    out1, in2 = F.col("v1_outward"), F.col("v2_inward")

    def view(place, near, far, near_outward, far_inward):
        return F.struct(
            near.alias("v"), F.lit(place).alias("place"),
            F.format_string(BIDIGRAPH_FORMAT, near + 1, F.when(near_outward, ">").otherwise("<"),
                            F.when(far_inward, ">").otherwise("<"), far + 1).alias("ends"))

    loop = F.col("v1") == F.col("v2")
    views = F.array(
        view(1, F.col("v1"), F.col("v2"), out1, in2),
        view(2, F.col("v2"), F.col("v1"), F.when(loop, out1).otherwise(~in2), F.when(loop, in2).otherwise(~out1)),
    )
    text = F.concat_ws("\t", F.col("x.ends"), _attributes(), _label("seq12", seqs), _label("seq21", seqs))
    return graph.edges.withColumn("x", F.explode(views)).select(
        F.col("x.v").alias("v"), "edge_id", F.col("x.place").alias("place"), text.alias("line")
    )


def print_graph(graph: StringGraph, seqs: bool = False) -> DataFrame:
    return print_digraph(graph, seqs) if graph.kind == "digraph" else print_bidigraph(graph, seqs)


def graph_dot(graph: StringGraph, seqs: bool = False) -> DataFrame:
    """``(part, a, b, line)``: DOT text in the order head, vertices, edges, tail."""
    spark = graph.edges.sparkSession
    head = [*DOT_HEAD] + ([DOT_DIGRAPH_STYLE] if graph.kind == "digraph" else [])
    frame = [(0, i, 0, text) for i, text in enumerate(head)] + [(3, 0, 0, DOT_TAIL)]
    fixed = spark.createDataFrame(frame, "part int, a long, b long, line string")
    lines = _dot_digraph(graph, seqs) if graph.kind == "digraph" else _dot_bidigraph(graph, seqs)
    return fixed.unionByName(lines)


def _dot_rows(graph: StringGraph, vertex_line: Column, edge_line: Column) -> DataFrame:
    vertices = graph.vertices.select(
        F.lit(1).alias("part"), F.col("v").alias("a"), F.lit(0).cast("long").alias("b"), vertex_line.alias("line"))
    edges = graph.edges.select(
        F.lit(2).alias("part"), F.col("v1").alias("a"), F.col("edge_id").alias("b"), edge_line.alias("line"))
    return vertices.unionByName(edges)


def _dot_digraph(graph: StringGraph, seqs: bool) -> DataFrame:
    v = F.col("v")
    vertex = F.format_string('\tv%d [ label="%d.%s" fillcolor=%s ];', v, F.shiftright(v, 1) + 1, _side(v),
                             F.when(v % 2 == 1, "green").otherwise("cyan"))
    edge = F.format_string('\tv%d -> v%d [ label="%s" %s];', F.col("v1"), F.col("v2"), _label("seq", seqs),
                           F.when(F.col("traversal_count") != 0, "color=red ").otherwise(""))
    return _dot_rows(graph, vertex, edge)


def _dot_bidigraph(graph: StringGraph, seqs: bool) -> DataFrame:
    vertex = F.format_string('\tv%d [ label = "%d" ];', F.col("v"), F.col("v") + 1)
    tail = F.when(F.col("v1_outward"), "inv").otherwise("normal")
    arrow = F.when(F.col("v2_inward"), "normal").otherwise("inv")
    size = F.length("seq12").cast("double")
    if seqs:
        angle = 90 - (180 / (2.0 * math.pi)) * F.atan(F.lit(DOT_CURVE) / size)
        label = F.format_string(' taillabel="%s" headlabel="%s" labelangle=%s labeldistance=%s', F.col("seq12"),
                                F.col("seq21"), short_number(angle), short_number(size / 2.5 + 1.0))
    else:
        label = F.format_string(' label="%d"', F.length("seq12"))
    colour = F.when(F.col("traversal_count") != 0, " color=red ").otherwise("")
    edge = F.format_string("\tv%d -> v%d [ dir=both arrowhead=%s arrowtail=%s%s%s ];", F.col("v1"), F.col("v2"),
                           arrow, tail, label, colour)
    return _dot_rows(graph, vertex, edge)
