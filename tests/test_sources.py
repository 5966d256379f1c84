"""Formats, stored tables, generators and helpers."""

import pytest
from fixtures import TEN_READS, rc, reads_df
from pyspark.sql import functions as F

from strandweave import functions as fn
from strandweave.operators import ranking, render, string_graph
from strandweave.plans.assembly import Assembly
from strandweave.sources import generators, reads, storage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta_quirks(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">r1 first read\nacgt\nAC GT\n>empty\n>r2>x\r\nTT\r\nGG\r\n\n>r3\nCCC")
    assert rows(reads.read_reads(spark, str(path))) == [(0, "ACGTACGT"), (1, "TTGG"), (2, "CCC")]


def test_fastq_with_a_partial_record_fails_or_is_quarantined(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("@a\nACGT\n+\n@@@@\n\n@b\nGGTT\n+x\n>>>>\n@c\nAAAA\n")
    with pytest.raises(Exception, match="incomplete or out of step"):
        reads.read_reads(spark, str(path)).collect()
    assert rows(reads.scan_fastq(spark, str(path), on_bad="quarantine")) == [(0, "ACGT"), (1, "GGTT")]
    assert [r["text"] for r in reads.fastq_faults(spark, str(path)).orderBy("place").collect()] == ["@c", "AAAA"]


def test_fastq_out_of_step_fails(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("@a\nACGT\n@@@@\n@b\nGGTT\n+\n>>>>\n+\n")
    with pytest.raises(Exception, match="incomplete or out of step"):
        reads.read_reads(spark, str(path)).collect()
    assert reads.fastq_faults(spark, str(path)).count() == 3


def test_many_splits_keep_file_order(spark, tmp_path):
    text = "".join(f">r{i}\n{'ACGT'[i % 4] * (i % 90 + 1)}\n" for i in range(400))
    path = tmp_path / "big.fa"
    path.write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scanned = reads.scan_fasta(spark, [str(path), str(path)])
        got = rows(scanned)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = ["ACGT"[i % 4] * (i % 90 + 1) for i in range(400)]
    assert got == list(enumerate(want + want))


@pytest.mark.parametrize("name", ["x.fasta", "x.FA", "x.fq", "x.fastq", "x.parquet", "x"])
def test_written_reads_come_back(spark, tmp_path, name):
    source = reads_df(spark, TEN_READS + ["ACGT" * 40, "A" * 70])
    path = str(tmp_path / name)
    reads.write_reads(source, path)
    if name.lower().endswith(("fa", "fasta", "fq", "fastq")):
        assert rows(reads.read_reads(spark, path)) == rows(source)
    else:
        assert rows(reads.read_reads(spark, path, "parquet")) == rows(source)


def test_fasta_wrap(spark):
    record = reads.fasta_lines(reads_df(spark, ["A" * 141])).first().record
    assert record.split("\n") == [">read_1", "A" * 70, "A" * 70, "A"]


def test_mixed_inputs_are_renumbered(spark, tmp_path):
    a, b, out = (str(tmp_path / n) for n in ("a.fa", "b.fq", "c.parquet"))
    reads.write_reads(reads_df(spark, ["ACGT", "GGG"]), a)
    reads.write_reads(reads_df(spark, ["TTT"]), b)
    reads.convert_reads(spark, [a, b], out)
    assert rows(reads.read_reads(spark, out)) == [(0, "ACGT"), (1, "GGG"), (2, "TTT")]


def test_bad_inputs(spark, tmp_path):
    path = tmp_path / "n.fa"
    path.write_text(">a\nACGN\n")
    with pytest.raises(Exception, match="letters other than ACGT"):
        reads.read_reads(spark, str(path)).collect()
    assert reads.invalid_reads(reads.read_reads(spark, str(path), check=False)).count() == 1
    other = tmp_path / "n.txt"
    other.write_text("hello\n")
    with pytest.raises(ValueError, match="unknown file type"):
        reads.detect_format(spark, str(other))


def test_graph_storage_round_trip(spark, tmp_path):
    run = Assembly(reads_df(spark, TEN_READS), 15)
    path = str(tmp_path / "g")
    storage.write_graph(run.reduced, path)
    back = storage.read_graph(spark, path, "digraph")
    assert rows(back.edges) == rows(run.reduced.edges)
    assert back.orig_num_reads == 10
    with pytest.raises(ValueError):
        storage.read_graph(spark, path, "bidigraph")
    broken = run.reduced.with_edges(run.reduced.edges.where("edge_id <> (SELECT 0)").limit(5))
    with pytest.raises(ValueError):
        storage.write_graph(broken, str(tmp_path / "h"))
    bidi = string_graph.to_bidigraph(run.collapsed)
    storage.write_graph(bidi, str(tmp_path / "b"))
    assert storage.read_graph(spark, str(tmp_path / "b")).kind == "bidigraph"
    assert len(render.print_graph(bidi, seqs=True).collect()) == 2
    lines = [r.line for r in render.graph_dot(bidi, seqs=True).orderBy("part", "a", "b").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and "labelangle=" in lines[-2]


def test_generators(spark):
    genome = generators.random_genome(spark, 1000, seed=4)
    text = "".join(r.bases for r in genome.orderBy("block_no").collect())
    assert len(text) == 1000 and set(text) == set("ACGT")
    assert text == "".join(r.bases for r in generators.random_genome(spark, 1000, 4).orderBy("block_no").collect())
    got = generators.simulate_uniform_reads(genome, 100, coverage=3, allow_rc=True).collect()
    assert len(got) == 30 and {r.strand for r in got} == {"+", "-"}
    for r in got:
        window = text[r.start:r.start + 100]
        assert r.seq == (rc(window) if r.strand == "-" else window)
    spaced = generators.simulate_uniform_reads(genome, 100, read_sep=50).collect()
    assert sorted(r.start for r in spaced) == list(range(0, 901, 50))


def test_fasta_head(spark):
    lines = spark.createDataFrame([(0, ">g"), (1, "A" * 10), (2, "C" * 10), (3, "G" * 10)], "line_no long, line string")
    assert rows(generators.fasta_head(lines, nbytes=15)) == [(0, ">g"), (1, "A" * 10), (2, "C" * 5)]
    assert rows(generators.fasta_head(lines, nlines=1)) == [(0, ">g"), (1, "A" * 10)]


def test_ranking_across_chunks(spark):
    df = spark.createDataFrame([(k,) for k in (5, 17, 3, 40, 41, 99)], "k long")
    assert rows(ranking.dense_ids(df, "k", "n")) == [(3, 0), (5, 1), (17, 2), (40, 3), (41, 4), (99, 5)]
    assert rows(ranking.dense_order(df, ["k"], "n")) == [(3, 0), (5, 1), (17, 2), (40, 3), (41, 4), (99, 5)]
    far = spark.createDataFrame([(i << 40,) for i in (7, 1, 30)], "k long")
    assert rows(ranking.dense_ids(far, "k", "n")) == [(1 << 40, 0), (7 << 40, 1), (30 << 40, 2)]
    assert [r.t for r in ranking.running_total(df, "k", "k", "t").orderBy("k").collect()] == [0, 3, 8, 25, 65, 106]
    grouped = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    ranks = ranking.group_ranks(grouped, ["g"], "id", "r", buckets=7).groupBy("g").agg(
        F.countDistinct("r").alias("d"), F.max("r").alias("m"), F.count("*").alias("n"))
    assert all(r.d == r.n == r.m + 1 for r in ranks.collect())


def test_scalar_functions(spark):
    df = spark.createDataFrame([("acgN", "ACGTT")], "raw string, seq string").select(
        fn.is_dna(fn.normalise("raw")), fn.reverse_complement("seq"), fn.slice_seq("seq", F.lit(1), F.lit(3)),
        fn.slice_seq("seq", F.lit(1), F.lit(3), True), fn.set_base("seq", F.lit(0), F.lit("T")),
        fn.base_code(F.lit("t")), fn.base_code(F.lit("N")), fn.base_letter(F.lit(2)), fn.kmers("seq", 4),
        fn.kmers("raw", 9), fn.kmer_is_rc(F.lit("ACGT")), fn.kmer_is_rc(F.lit("AACC")))
    assert tuple(df.first()) == (
        False, "AACGT", "CGT", "ACG", "TCGTT", 3, 4, "G", ["ACGT", "CGTT"], [], True, False)
    assert [fn.seed_length(n) for n in (4, 7, 8, 25, 40, 500)] == [4, 4, 8, 24, 40, 128]
    assert fn.parse_bounded_int("12", "-l", 4) == 12
    for bad in ("x", "3"):
        with pytest.raises(ValueError):
            fn.parse_bounded_int(bad, "-l", 4)


def test_short_number(spark):
    values = [0.0, 1.0, 10.0, 506.0, -350.7324733633323, 2.5, 0.0001234567, 123456.7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.s for r in df.select("i", render.short_number(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == [f"{v:g}" for v in values]


def test_short_numbers_like_general_format(spark):
    values = [0.0, 1.0, -2.5, 1e6, 1234567.0, 999999.5, 999999.4, 1e-4, 1e-5, 0.00001234, 123456.7, 1e21, 0.1 + 0.2, -1e-7, 100000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", render.short_number(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:g}" for v in values]


def test_ceil_div_is_exact_beyond_double(spark):
    big = (1 << 62) + 1
    row = spark.createDataFrame([(big, 2), (6, 3), (7, 3)], "a long, b long").select(fn.ceil_div(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in row] == [(big + 1) // 2, 2, 3]
