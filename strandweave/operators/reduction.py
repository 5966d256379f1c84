"""Transitive reduction: drop v -> x where v -> w -> x spells the same label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.string_graph import StringGraph, edge_len, to_digraph
from strandweave.session import cut_lineage


_ENDS = ("d", "out_low", "out_high", "in_low", "in_high")


def _owned(e: DataFrame) -> DataFrame:
    """``(p, end, other, len, out_low, out_high, in_low, in_high)``: each edge at its endpoint of lesser degree.

    ``end`` is twice the edge's id, and one more where the edge leaves ``p``.

    Whatever the degrees, no vertex owns more than the order of sqrt(edges) of them. A loop is
    listed both as leaving and as entering its vertex. The last four are the shortest and longest edge that
    leave and enter ``other``.
    """
    ends = e.select(F.explode(F.array(
        F.struct(F.col("v1").alias("v"), F.col("len").alias("out"), F.lit(None).cast("long").alias("in")),
        F.struct(F.col("v2").alias("v"), F.lit(None).cast("long").alias("out"), F.col("len").alias("in")),
    )).alias("x")).select("x.*")
    vertex = ends.groupBy("v").agg(
        F.count("*").alias("d"), F.min("out").alias("out_low"), F.max("out").alias("out_high"),
        F.min("in").alias("in_low"), F.max("in").alias("in_high"))
    ranked = e
    for k in (1, 2):
        ranked = ranked.join(vertex.select(F.col("v").alias(f"v{k}"), F.struct(*_ENDS).alias(f"at{k}")), f"v{k}")
    at_tail = F.struct(F.col("v1").alias("p"), F.lit(True).alias("leaves"), F.col("v2").alias("other"), F.col("at2").alias("x"))
    at_head = F.struct(F.col("v2").alias("p"), F.lit(False).alias("leaves"), F.col("v1").alias("other"), F.col("at1").alias("x"))
    owner = (
        F.when(F.col("v1") == F.col("v2"), F.array(at_tail, at_head))
        .when(F.struct("at1.d", "v1") < F.struct("at2.d", "v2"), F.array(at_tail))
        .otherwise(F.array(at_head))
    )
    return ranked.select("edge_id", "len", F.explode(owner).alias("o")).select(
        (F.shiftleft("edge_id", 1) + F.col("o.leaves").cast("int")).alias("end"), "len", "o.p", "o.other", *[F.col(f"o.x.{c}").alias(c) for c in _ENDS[1:]])


def _corner_pairs(e: DataFrame) -> DataFrame:
    """``(v1, v2, len, a, b, corner)``: two edges that meet where both are owned, and the third edge they call for.

    Joining at the corner of least degree keeps a vertex with a million edges on either side from
    producing all pairs of them. A third edge can only be as long as some edge that leaves its tail
    and some that enters its head, so pairs that no edge can complete go no further.
    """
    # Written once: both sides of the self-join then read the same narrow rows.
    owned = cut_lineage(_owned(e))
    one, two = owned.alias("a"), owned.alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # Both sides take every column and neither has a filter of its own, so the rows are shuffled once for both.
    kind = a("end").bitwiseAND(F.lit(1)) + 2 * b("end").bitwiseAND(F.lit(1))
    through = kind == 2
    fork = (kind == 3) & (a("len") < b("len"))
    meet = (kind == 0) & (a("len") < b("len"))
    size = F.when(through, a("len") + b("len")).otherwise(b("len") - a("len"))

    def between(low: str, high: str, tail: bool):
        # The third edge leaves a's other end, but b's where both edges enter the corner.
        near, far = (a, b) if tail else (b, a)
        return F.when(meet, size.between(far(low), far(high))).otherwise(size.between(near(low), near(high)))

    return one.join(two, a("p") == b("p")).where(
        (through | fork | meet) & between("out_low", "out_high", True) & between("in_low", "in_high", False)
    ).select(
        F.when(meet, b("other")).otherwise(a("other")).alias("v1"),
        F.when(meet, a("other")).otherwise(b("other")).alias("v2"),
        size.alias("len"), F.shiftright(a("end"), 1).alias("a"), F.shiftright(b("end"), 1).alias("b"),
        F.when(through, 0).when(fork, 1).otherwise(2).alias("corner"),
    )


def _triangles(e: DataFrame) -> DataFrame:
    """``(e1, e2, e3)``: edges v -> w, w -> x and v -> x whose lengths add up.

    The third edge of a corner pair is looked up by its ends and length.
    """
    pairs = _corner_pairs(e)
    third = e.select("v1", "v2", "len", F.col("edge_id").alias("c"))
    corner = F.col("corner")
    return pairs.join(third, ["v1", "v2", "len"]).select(
        F.when(corner == 2, F.col("c")).otherwise(F.col("a")).alias("e1"),
        F.when(corner == 0, F.col("b")).when(corner == 1, F.col("c")).otherwise(F.col("a")).alias("e2"),
        F.when(corner == 0, F.col("c")).otherwise(F.col("b")).alias("e3"),
    )


def transitive_edges(edges: DataFrame, labels_follow_lengths: bool = False) -> DataFrame:
    """``(edge_id)`` of edges explained by a two-edge path.

    Paths are matched on ends and lengths; text is compared only for what remains.

    ``labels_follow_lengths`` skips the text and works on an edge skeleton. It holds for
    graphs built from exact overlaps: if the lengths add up, both routes place x at the
    same offset from v, and as v overlaps both w and x, the overlap of w and x covers
    all of w beyond v. The bases then agree because the overlap is exact.
    """
    columns = ["edge_id", "v1", "v2", edge_len(edges).cast("long").alias("len")]
    if labels_follow_lengths:
        return _triangles(edges.select(*columns)).select(F.col("e3").alias("edge_id")).distinct()
    # Written once, read by columns: the search for paths moves no text.
    texts = cut_lineage(edges.select(*columns, "seq"))
    found = cut_lineage(_triangles(texts.select("edge_id", "v1", "v2", "len")))
    # One path is enough, so all others are compared only for edges that the first does not explain.
    first = cut_lineage(found.groupBy("e3").agg(F.min(F.struct("e1", "e2")).alias("x")).select("x.e1", "x.e2", "e3"))
    gone = cut_lineage(_spelled(first, texts))
    if gone.count() < first.count():
        gone = gone.unionByName(_spelled(found.join(gone, "e3", "left_anti"), texts))
    return gone.select(F.col("e3").alias("edge_id"))


def _spelled(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``(e3)``: edges of which some triangle spells the label."""
    for name in ("e1", "e2", "e3"):
        found = found.join(texts.select(F.col("edge_id").alias(name), F.col("seq").alias(f"{name}_seq")), name)
    return found.where(F.concat("e1_seq", "e2_seq") == F.col("e3_seq")).select("e3").distinct()


def reduced_skeleton(skeleton: DataFrame) -> DataFrame:
    """A skeleton of exact overlaps without its transitive edges; see ``transitive_edges`` for why lengths suffice.

    Nearly every transitive edge has the shortest edge of its tail as its first step, or its twin has, so one
    lookup an edge settles these. A shortest edge is never transitive, and twins leave or stay together. Only for
    what neither rule settles are all triangles listed.
    """
    columns = skeleton.columns
    near = skeleton.groupBy("v1").agg(F.min("len").alias("near_len"), F.min_by("v2", "len").alias("near"))
    asked = skeleton.join(near, "v1").withColumn("more", F.col("len") - F.col("near_len"))
    second = skeleton.select(F.col("v1").alias("near"), "v2", F.col("len").alias("more"))
    left = asked.join(second, ["near", "v2", "more"], "left_anti")
    twins = left.groupBy(F.least("edge_id", "twin_id").alias("pair")).agg(
        F.collect_list(F.struct(*columns, "more")).alias("both"))
    whole = twins.where((F.size("both") == 2) | (F.col("both")[0]["edge_id"] == F.col("both")[0]["twin_id"]))
    rest = cut_lineage(whole.withColumn("settled", F.array_min("both.more") == 0).select("settled", F.explode("both").alias("e")).select(
        "settled", *[F.col(f"e.{c}").alias(c) for c in columns]))
    kept, unsettled = rest.select(*columns), rest.where("NOT settled")
    if unsettled.isEmpty():
        return kept
    # All edges of a triangle leave the tail, or enter the head, of its transitive one.
    at = [unsettled.select(F.col(c), F.lit(True).alias(f"at_{c}")).distinct() for c in ("v1", "v2")]
    around = cut_lineage(skeleton.join(at[0], "v1", "left").join(at[1], "v2", "left").where("at_v1 OR at_v2").select(*columns))
    return kept.join(transitive_edges(around, labels_follow_lengths=True), "edge_id", "left_anti").select(*columns)


def transitive_reduction(graph: StringGraph, labels_follow_lengths: bool = False) -> StringGraph:
    """Graph without transitive edges. Twins leave together, ids of the rest stay."""
    if graph.kind == "bidigraph":
        # Twins leave together, so a bidirected edge goes if either direction does; the rest is untouched.
        gone = transitive_edges(to_digraph(graph).edges, labels_follow_lengths)
        pairs = gone.select(F.shiftright("edge_id", 1).alias("edge_id")).distinct()
        return graph.with_edges(graph.edges.join(pairs, "edge_id", "left_anti"))
    gone = transitive_edges(graph.edges, labels_follow_lengths)
    return graph.with_edges(graph.edges.join(gone, "edge_id", "left_anti"))
