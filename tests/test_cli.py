"""The stage-by-stage command line on the ten-read example."""

from fixtures import TEN_READ_OVERLAPS, TEN_READS, reads_df

from strandweave.cli import COMMANDS, main, parser
from strandweave.sources import reads, storage


def test_pipeline_of_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    reads.write_reads(reads_df(spark, TEN_READS), at("in.fa"))
    steps = [
        ["convert-reads", at("in.fa"), at("reads.parquet")],
        ["compute-overlaps", at("in.fa"), at("ov"), "-l", "15"],
        ["print-overlaps", at("ov"), at("ov.txt")],
        ["remove-contained-reads", at("in.fa"), at("kept.fa"), at("ov"), at("kept_ov"), at("index")],
        ["build-directed-string-graph", at("kept.fa"), at("kept_ov"), at("di")],
        ["build-bidirected-string-graph", at("kept.fa"), at("kept_ov"), at("bi")],
        ["transitive-reduction", at("di"), at("reduced")],
        ["map-contained-reads", at("in.fa"), at("ov"), at("index"), at("reduced"), at("mapped")],
        ["collapse-unbranched-paths", at("mapped"), at("collapsed")],
        ["calculate-A-statistics", at("collapsed"), at("calc")],
        ["min-cost-circulation", at("calc"), at("circ")],
        ["digraph-to-bidigraph", at("circ"), at("out")],
        ["bidigraph-eulerian-cycle", at("out"), at("cycle")],
        ["extract-edge-seqs", at("collapsed"), at("seqs.fa")],
        ["print-string-graph", "--dot", at("collapsed"), at("dot")],
        ["print-string-graph", at("collapsed"), at("txt")],
        ["print-string-graph", "--stats", at("bi"), at("stats")],
    ]
    for step in steps:
        assert main(step, spark) == 0, step
    lines = [r.value for r in spark.read.text(at("ov.txt")).collect()]
    assert sorted(lines) == sorted(TEN_READ_OVERLAPS)
    assert {len(r.seq) for r in reads.read_reads(spark, at("seqs.fa")).collect()} == {113}
    assert storage.read_table(spark, at("cycle"), storage.CYCLE_SCHEMA).count() > 0
    assert main(["min-cost-circulation", at("bi"), at("bad")], spark) == 1
    assert main(["compute-overlaps", at("in.fa"), at("bad2"), "-l", "3"], spark) == 1
    assert main(["compute-overlaps", at("in.fa"), at("bad3"), "-e", "1"], spark) == 1


def test_every_command_parses():
    for name, args in COMMANDS.items():
        assert parser().parse_args([name, *["x"] * len(args)]).command == name
