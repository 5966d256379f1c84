"""Folding copies must change nothing but the work done."""

import random

import pytest
from fixtures import rc, reads_df
from test_overlaps import dna, sample

from strandweave.operators import containment, mapping, overlaps
from strandweave.plans.assembly import Assembly


def heavy_copies(seed):
    rng = random.Random(seed)
    unit = dna(rng, 6)
    genome = dna(rng, 90) + unit * 12 + dna(rng, 90)
    reads = sample(rng, genome, 50, 24, 60)
    # A third of all reads are one sequence, others occur in both orientations.
    reads += [reads[3] if i % 3 else rc(reads[3]) for i in range(40)]
    reads += [rng.choice((r, rc(r))) for r in reads[:20]] + [unit * 5, unit * 5, rc(unit * 5), unit * 7]
    rng.shuffle(reads)
    return reads


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_equals_unfolded(spark, seed):
    run = Assembly(reads_df(spark, heavy_copies(seed)), 15)
    full = run.all_overlaps
    assert full.count() > 3 * run.overlaps.count()
    contained = containment.contained_reads(full)
    plain = containment.old_to_new_indices(run.reads, contained)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, run.index_map.collect()))
    kept = containment.uncontained_overlaps(full, plain)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, run.kept_overlaps.collect()))
    want = mapping.contained_overhangs(full, plain)
    got = mapping.nearest_containers(run.placements)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_overlaps_of_copies_are_searched_again(spark):
    run = Assembly(reads_df(spark, heavy_copies(3)), 15)
    full = run.all_overlaps
    again = overlaps.compute_overlaps(run.reads, 15)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, again.select(*full.columns).collect()))
    assert "copy_overlaps" in run.seconds and "all_overlaps" not in run.seconds
