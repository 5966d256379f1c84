"""Labels as ropes, lists followed to their end, walks by offsets."""

import random
from collections import Counter

import pytest
from fixtures import rc
from test_graph import digraph

from strandweave.operators import collapse, degrees, mapping, pointers, string_graph
from strandweave.operators.contigs import contig_fasta
from strandweave.session import cut_lineage


def text_rows(graph):
    return sorted(tuple(r) for r in graph.edges.collect())


def test_ropes_and_text_are_the_same_graph(spark):
    """Collapsing and both conversions with pieces give what they give with text."""
    rng = random.Random(4)
    pairs = [(2 * k + 1, 2 * k + 3, "ACGT"[k % 4] * (k % 5 + 1), rc("ACGT"[k % 4] * (k % 5 + 1))) for k in range(12)]
    pairs += [(rng.randrange(1, 40, 2), rng.randrange(40), "ACG", "CGT") for _ in range(5)]
    graph = digraph(spark, pairs, 20)
    rope = string_graph.as_rope(graph)
    assert "seq" not in rope.edges.columns
    assert text_rows(string_graph.with_text(rope)) == text_rows(graph)
    merged = collapse.collapse_unbranched(rope)
    assert merged.pieces is not None
    assert text_rows(string_graph.with_text(merged)) == text_rows(collapse.collapse_unbranched(graph))
    both = string_graph.to_bidigraph(merged)
    assert text_rows(string_graph.with_text(both)) == text_rows(string_graph.to_bidigraph(collapse.collapse_unbranched(graph)))
    back = string_graph.with_text(string_graph.to_digraph(both))
    assert text_rows(back) == text_rows(string_graph.to_digraph(string_graph.with_text(both)))
    assert text_rows(string_graph.with_text(string_graph.renumber(merged))) == text_rows(
        string_graph.renumber(string_graph.with_text(merged)))


@pytest.mark.parametrize("local", [1_000, 3])
def test_lists_and_rings_end_where_they_should(spark, local):
    """Three lists and two rings, by one task and by rounds."""
    lists = [list(range(0, 37)), list(range(100, 101)), list(range(200, 217))]
    rows = [(x, run[k - 1] if k else x, int(k > 0), 10 * int(k > 0), k == 0) for run in lists for k, x in enumerate(run)]
    rings = [list(range(300, 308)), [400]]
    rows += [(x, ring[k - 1], 1, 1, False) for ring in rings for k, x in enumerate(ring)]
    random.Random(1).shuffle(rows)
    links = spark.createDataFrame(rows, "id long, ptr long, dist long, weight long, done boolean")
    got = {r["id"]: r for r in pointers.follow(links, local).collect()}
    for run in lists:
        for k, x in enumerate(run):
            assert (got[x]["ptr"], got[x]["dist"], got[x]["weight"], got[x]["done"]) == (run[0], k, 10 * k, True)
    assert not any(got[x]["done"] for ring in rings for x in ring)
    names = pointers.ring_names(links.where("id >= 300").select("id", "ptr"), local)
    assert {r["id"]: r["ring"] for r in names.collect()} == {x: ring[0] for ring in rings for x in ring}


def plain_walk(edges, v, residual):
    """Every path backwards, edge by edge."""
    hits, front = Counter(), [(v, residual)]
    while front:
        at, left = front.pop()
        for e, (v1, v2, size) in edges.items():
            if v2 == at:
                if left < size:
                    hits[e] += 1
                else:
                    front.append((v1, left - size))
    return hits


def walked(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r["v"], r["residual"]), Counter())[r["edge_id"]] = int(r["hits"])
    return out


def test_walks_by_offsets_count_every_path(spark):
    rng = random.Random(7)
    edges = {}
    for start in (0, 30, 60):
        for k in range(12):
            edges[len(edges)] = (start + k, start + k + 1, rng.randint(1, 40))
    for a, b in ((12, 30), (12, 60), (42, 60), (72, 80), (42, 80), (12, 30)):
        edges[len(edges)] = (a, b, rng.randint(1, 9))
    ring = [(90, 91, 3), (91, 92, 2), (92, 90, 4)]
    for e in ring:
        edges[len(edges)] = e
    table = cut_lineage(spark.createDataFrame([(k, *e) for k, e in edges.items()], "edge_id long, v1 long, v2 long, len long"))
    starts = [(v, r) for v in (0, 5, 12, 30, 37, 42, 66, 72, 80, 90, 91) for r in (0, 1, 7, 25, 90)]
    frame = spark.createDataFrame([(v, r, 1) for v, r in starts], "v long, residual int, reads long")
    want = {s: h for s in starts if (h := plain_walk(edges, *s))}
    assert walked(mapping.walk_back(frame, table)) == want
    capped = walked(mapping.walk_back(frame, table, cap=2))
    assert capped == {s: h for s, h in want.items() if sum(h.values()) < 2}


def test_rounds_of_a_walk_count_branchings(spark, monkeypatch):
    """Labels of one base and reads of 1,000: a walk passes thousands of edges in a few rounds."""
    edges = [(k, k + 1, 1) for k in range(3000)] + [(5000 + k, 5001 + k, 1) for k in range(1500)] + [(6500, 1500, 1)]
    table = cut_lineage(spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id long, v1 long, v2 long, len long"))
    frame = spark.createDataFrame([(v, r, 1) for v, r in ((3000, 999), (2400, 950), (1600, 150), (1500, 0))], "v long, residual int, reads long")
    by_id = dict(enumerate(edges))
    rounds = []
    plain = mapping.cut_lineage
    monkeypatch.setattr(mapping, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    got = walked(mapping.walk_back(frame, table))
    into = {}
    for e, (v1, v2, size) in by_id.items():
        into.setdefault(v2, []).append((e, v1, size))

    def quick(v, left):
        hits, front = Counter(), [(v, left)]
        while front:
            at, left = front.pop()
            for e, v1, size in into.get(at, ()):
                hits.update([e]) if left < size else front.append((v1, left - size))
        return hits

    assert got == {s: h for s in ((3000, 999), (2400, 950), (1600, 150), (1500, 0)) if (h := quick(*s))}
    # Positions, placed edges, and a round per branching and one more.
    assert len(rounds) <= 2 + 1 + 2


@pytest.mark.parametrize("local", [100_000, 0])
def test_components_of_a_star_a_path_and_loops(spark, monkeypatch, local):
    """Also where the crowded vertex is looked up by broadcast and forests are thinned batch by batch."""
    monkeypatch.setattr(degrees, "FOREST_ROWS", 50)
    edges = [(9000, k) for k in range(1, 400)] + [(500 + k, 501 + k) for k in range(150)] + [(7000, 7000), (7001, 7002)]
    random.Random(2).shuffle(edges)
    table = spark.createDataFrame(edges, "v1 long, v2 long").repartition(6)
    vertices = spark.createDataFrame([(v,) for v in sorted({x for e in edges for x in e} | {42_000})], "v long")
    got = {r["v"]: r["component"] for r in degrees.components(vertices, table, local).collect()}
    for v, c in got.items():
        assert c == (1 if v < 400 or v == 9000 else 500 if v <= 650 else 7001 if v in (7001, 7002) else v)


def test_contig_lines_are_wrapped_across_pieces(spark):
    rng = random.Random(3)
    texts = {0: [rng.choice(["", "A"]) or "ACGT" * rng.randint(1, 60) for _ in range(9)], 1: ["AC" * 35, "G" * 140, "T"], 2: ["A"]}
    pieces = spark.createDataFrame([(c, k, t) for c, run in texts.items() for k, t in enumerate(run)], "contig long, piece long, seq string")
    lines = [(r["contig"], r["line"]) for r in contig_fasta(pieces).orderBy("contig", "piece").collect()]
    for c, run in texts.items():
        mine = [line for k, line in lines if k == c]
        whole = "".join(run)
        assert mine == [f">contig_{c + 1}"] + [whole[i:i + 70] for i in range(0, len(whole), 70)]
