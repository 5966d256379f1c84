"""Random genomes, simulated reads and FASTA excerpts, all derived row by row from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.sequence import BASES, reverse_complement
from strandweave.operators.ranking import running_total
from strandweave.sources.tables import genome_tiles

# Fixed value: bases per line.
LINE_WIDTH = 70


def random_genome(spark: SparkSession, length: int, seed: int = 1) -> DataFrame:
    """``(block_no, bases)``: uniform random bases in lines of 70; each line depends on its number only."""
    lines = -(-length // LINE_WIDTH)
    at = F.col("id") * LINE_WIDTH
    width = F.least(F.lit(LINE_WIDTH), F.lit(length) - at)
    letters = F.transform(
        F.sequence(F.lit(0).cast("long"), width - 1),
        lambda j: F.substring(F.lit(BASES), F.pmod(F.xxhash64(F.lit(seed), at + j), F.lit(4)).cast("int") + 1, F.lit(1)),
    )
    return spark.range(lines).select(F.col("id").alias("block_no"), F.array_join(letters, "").alias("bases"))


def simulate_uniform_reads(blocks: DataFrame, read_len: int, coverage: float | None = None,
                           read_sep: int | None = None, allow_rc: bool = False, seed: int = 1) -> DataFrame:
    """``(read_id, start, strand, seq)`` sampled from ``(block_no, bases)`` of equal-length blocks.

    With ``coverage``, starts are uniform below ``genome length - read_len``; with
    ``read_sep`` they are evenly spaced.
    """
    if (coverage is None) == (read_sep is None):
        raise ValueError("give either coverage or read_sep")
    spark = blocks.sparkSession
    size = blocks.agg(F.max(F.length("bases")), F.sum(F.length("bases"))).first()
    block_len, genome_len = size[0], size[1]
    if coverage is not None:
        total = max(0, -(-int(genome_len * coverage * 1000) // (read_len * 1000)))
        span = max(genome_len - read_len, 0)
        start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), F.col("id")), F.lit(max(span, 1)))
        total = total if span > 0 else 0
    else:
        total = max(0, (genome_len - read_len) // read_sep + 1) if genome_len >= read_len else 0
        start = F.col("id") * read_sep
    flipped = (F.pmod(F.xxhash64(F.lit(seed), F.lit("strand"), F.col("id")), F.lit(2)) == 0) & F.lit(allow_rc)
    layout = spark.range(total).select(
        F.col("id").alias("read_id"), start.alias("start"),
        F.when(flipped, "-").otherwise("+").alias("strand"),
    ).withColumn("block_no", F.floor(F.col("start") / block_len))
    tiles = genome_tiles(blocks, -(-(read_len + block_len - 1) // block_len))
    window = F.substring("tile", (F.col("start") % block_len + 1).cast("int"), F.lit(read_len))
    return layout.join(tiles, "block_no").select(
        "read_id", "start", "strand",
        F.when(F.col("strand") == "-", reverse_complement(window)).otherwise(window).alias("seq"),
    )


def fasta_head(lines: DataFrame, nbytes: int | None = None, nlines: int | None = None) -> DataFrame:
    """First bases or lines of FASTA text ``(line_no, line)``; headers do not count."""
    if nbytes is None and nlines is None:
        nlines = 10
    is_header = F.col("line").startswith(">")
    sized = lines.withColumn("bases", F.when(is_header, 0).otherwise(F.length("line"))).withColumn(
        "body", F.when(is_header, 0).otherwise(1))
    before = running_total(running_total(sized, "line_no", "bases", "bases_before"), "line_no", "body", "body_before")
    # A header that follows the cut is dropped with the rest.
    keep = F.lit(True)
    line = F.col("line")
    if nlines is not None:
        keep = keep & F.when(is_header, F.col("body_before") <= nlines).otherwise(F.col("body_before") < nlines)
    if nbytes is not None:
        keep = keep & (F.col("bases_before") < nbytes)
        line = F.when(is_header, line).otherwise(
            F.substring(line, F.lit(1), F.least(F.length("line"), F.lit(nbytes) - F.col("bases_before")).cast("int")))
    return before.where(keep).select("line_no", line.alias("line"))
