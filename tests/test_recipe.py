"""The whole recipe from read files: found again, gone on with, and done anew when its input changes."""

import os

import pytest
from fixtures import TEN_READ_CONTIG, TEN_READS, rc

from strandweave.plans import assembly
from strandweave.plans.assembly import assemble_files
from strandweave.plans.recipe import Store, listing_key
from strandweave.session import cut_lineage, dropped_rounds, path_exists


def write(path, reads):
    path.write_text("".join(f">r{k}\n{r}\n" for k, r in enumerate(reads)))
    return str(path)


def contig_texts(run):
    out = {}
    for r in run.contigs.orderBy("contig", "piece").collect():
        out[r["contig"]] = out.get(r["contig"], "") + r["seq"]
    return set(out.values())


def test_resume_change_and_interruption(spark, tmp_path, monkeypatch):
    path, root = write(tmp_path / "in.fa", TEN_READS), str(tmp_path / "store")
    first = assemble_files(spark, [path], 15, root)
    assert contig_texts(first) <= {TEN_READ_CONTIG, rc(TEN_READ_CONTIG)} and contig_texts(first)
    assert {"reads", "overlaps", "solved", "cycle", "contigs"} <= set(first.seconds)
    # The same input: nothing is computed, everything is found.
    again = assemble_files(spark, [path], 15, root)
    assert again.seconds == {} and contig_texts(again) == contig_texts(first)
    assert again.overlaps.schema == first.overlaps.schema
    # Another length: stages of the reads alone are found, the rest is not.
    other = assemble_files(spark, [path], 14, root)
    assert not {"reads", "copies", "distinct_reads"} & set(other.seconds) and "overlaps" in other.seconds
    # An interrupted run goes on after its last finished stage.
    store = Store(spark, listing_key(spark, [path]), str(tmp_path / "broken"))
    with monkeypatch.context() as patch:
        patch.setattr(assembly.euler, "eulerian_cycle", lambda graph: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            assemble_files(spark, [path], 15, str(tmp_path / "broken"))
    left = {r["stage"] for r in store.stages().collect()}
    assert "bidigraph" in left and "cycle" not in left
    rest = assemble_files(spark, [path], 15, str(tmp_path / "broken"))
    assert set(rest.seconds) == {"cycle", "contigs"} and contig_texts(rest) == contig_texts(first)
    # A changed file is another input; the old one's stages can be dropped.
    old = Store(spark, listing_key(spark, [path]), root)
    write(tmp_path / "in.fa", [r[:-1] for r in TEN_READS])
    os.utime(path, (1, 1))
    assert listing_key(spark, [path]) != old.input_key
    old.drop()
    assert not path_exists(spark, old.root)


def test_rounds_are_dropped_with_their_stage(spark):
    with dropped_rounds(spark):
        table = cut_lineage(spark.range(5))
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert path_exists(spark, path)
    assert not path_exists(spark, path)
    kept = cut_lineage(spark.range(5))
    assert kept.count() == 5
