"""Walks of contained reads start from placements alone."""

import random

from fixtures import rc, reads_df
from test_overlaps import dna

from strandweave.operators import mapping, string_graph
from strandweave.plans import catalog
from strandweave.plans.assembly import Assembly


def crowded_reads(seed):
    rng = random.Random(seed)
    genome = dna(rng, 500)
    seqs = [genome[p:p + rng.randint(40, 80)] for p in (rng.randrange(430) for _ in range(90))]
    seqs += [rc(s) for s in rng.choices(seqs, k=8)] + rng.choices(seqs, k=8)
    return seqs


def no_search(*_):
    raise AssertionError("all overlaps were searched for")


def rounded(rows):
    return {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows}


def test_walk_back_needs_no_search_for_all_overlaps(spark, monkeypatch):
    reads = reads_df(spark, crowded_reads(31)).localCheckpoint()
    run = Assembly(reads, 25)
    want_starts = mapping.walk_starts(mapping.contained_overhangs(run.all_overlaps, run.index_map))
    want = mapping.walk_back(want_starts, run.reduced_rope.edges)
    again = Assembly(reads, 25)
    monkeypatch.setattr(Assembly, "all_overlaps", property(no_search))
    got = catalog.STAGE_QUERIES["walk_back"](again)
    assert rounded(got.collect()) == rounded(want.collect()) and got.count() > 40
    starts = catalog.STAGE_QUERIES["walk_starts"](again)
    assert rounded(starts.collect()) == rounded(want_starts.collect())


def test_mapped_read_counts_need_no_search_for_all_overlaps(spark, monkeypatch):
    reads = reads_df(spark, crowded_reads(32)).localCheckpoint()
    run = Assembly(reads, 25)
    starts = mapping.walk_starts(mapping.contained_overhangs(run.all_overlaps, run.index_map))
    want = mapping.mapped_read_counts(starts, mapping.walk_back(starts, run.reduced_rope.edges))
    monkeypatch.setattr(Assembly, "all_overlaps", property(no_search))
    got = catalog.STAGE_QUERIES["mapped_read_counts"](Assembly(reads, 25))
    assert rounded(got.collect()) == rounded(want.collect()) and got.count() > 20


def test_repeated_ids_keep_the_rows_of_each(spark):
    seqs = crowded_reads(33)
    rows = list(enumerate(seqs)) + [(5, seqs[5]), (6, seqs[6]), (7, seqs[40]), (90, seqs[90])]
    run = Assembly(spark.createDataFrame(rows, "read_id long, seq string").localCheckpoint(), 25)
    assert not run.ids_differ
    want = mapping.walk_starts(mapping.contained_overhangs(run.all_overlaps, run.index_map))
    assert rounded(catalog.STAGE_QUERIES["walk_starts"](run).collect()) == rounded(want.collect())
    pieces = string_graph.with_text(run._graph(run.skeleton, run._labels(run.skeleton))).edges
    assert sorted(run.digraph.edges.collect()) == sorted(pieces.collect()) and pieces.count() > 0
