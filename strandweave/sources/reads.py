"""Read sets in FASTA, FASTQ and Parquet.

Text formats are read as ordinary splits. A read's number is its place in the input,
which follows from three things Spark knows without moving data: the order of files, the order of
splits in a file, and the row's place in its split. Only the table of row counts per
split is ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import is_dna, normalise

FORMATS = ("fasta", "fastq", "parquet")
# Fixed values of the text formats.
FASTA_WIDTH = 70
FASTQ_QUALITY = "@"
FASTA_SUFFIXES = ("fa", "fasta")
FASTQ_SUFFIXES = ("fq", "fastq")

_SPLIT = ["file_no", "file", "block"]


def detect_format(spark: SparkSession, path: str) -> str:
    """Format of an existing input, from its first characters."""
    text = spark.read.text(path)
    first = text.where(F.col("_metadata.file_block_start") == 0).select("value").take(1)
    head = first[0][0] if first else ""
    if head.startswith(">"):
        return "fasta"
    if head.startswith("@"):
        return "fastq"
    if head.startswith("PAR1"):
        return "parquet"
    raise ValueError(f"{path}: unknown file type")


def format_of_name(path: str) -> str:
    """Format of an output, from its extension; Parquet if there is no known one."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in FASTQ_SUFFIXES:
        return "fastq"
    if suffix in FASTA_SUFFIXES:
        return "fasta"
    return "parquet"


def _located(spark: SparkSession, paths: list[str], line_sep: str | None) -> DataFrame:
    parts = None
    for file_no, path in enumerate(paths):
        reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
        rows = reader.text(path).select(
            F.lit(file_no).alias("file_no"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_SPLIT).agg(F.min("slot").alias("slot0"), F.count("*").alias("n"))


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def scan_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(read_id, seq)`` of FASTA files; records without bases are dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    # A record is everything between two ">" at line starts; its first line is the header.
    body = F.regexp_replace("value", r"^>?[^\n]*\n?", "")
    rows = (
        _located(spark, paths, "\n>")
        .select(*_SPLIT, normalise(body).alias("seq"))
        .where(F.length("seq") > 0)
        .withColumn("slot", F.monotonically_increasing_id())
    )
    counts = _split_counts(rows)
    offsets = counts.select(*_SPLIT, "slot0", _before("n", Window.orderBy(*_SPLIT)).alias("offset"))
    return rows.join(offsets, _SPLIT).select(
        (F.col("offset") + F.col("slot") - F.col("slot0")).alias("read_id"), "seq"
    )


def _fastq_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, line, record, place, seq_line, whole, read_offset)``: non-blank lines with their places.

    ``place`` is the line's place in its record of four; ``whole`` is false in an incomplete last one.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = (
        _located(spark, paths, None)
        .where(F.length(F.trim("value")) > 0)
        .withColumn("slot", F.monotonically_increasing_id())
    )
    counts = _split_counts(rows)
    per_file = Window.partitionBy("file_no", "file")
    splits = counts.select(
        *_SPLIT, "slot0",
        _before("n", per_file.orderBy("block")).alias("line_offset"),
        F.floor(F.sum("n").over(per_file) / 4).cast("long").alias("records"),
    )
    files = counts.groupBy("file_no", "file").agg(F.floor(F.sum("n") / 4).alias("m")).select(
        "file_no", "file", _before("m", Window.orderBy("file_no", "file")).alias("read_offset")
    )
    line = F.col("line_offset") + F.col("slot") - F.col("slot0")
    record = F.expr("(line_offset + slot - slot0) div 4")
    return rows.join(splits.join(files, ["file_no", "file"]), _SPLIT).select(
        "file", (F.col("read_offset") + record).cast("long").alias("read_id"), (line % 4).cast("int").alias("place"),
        F.col("value").alias("text"), (record < F.col("records")).alias("whole"))


def fastq_faults(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, read_id, place, text, fault)``: lines of incomplete records, and first and third
    lines without their mark, which show a file out of step."""
    fault = (
        F.when(~F.col("whole"), "incomplete record")
        .when((F.col("place") == 0) & ~F.col("text").startswith("@"), "no @ line")
        .when((F.col("place") == 2) & ~F.col("text").startswith("+"), "no + line")
    )
    return _fastq_lines(spark, paths).select("file", "read_id", "place", "text", fault.alias("fault")).where("fault is not null")


def scan_fastq(spark: SparkSession, paths: str | list[str], on_bad: str = "fail") -> DataFrame:
    """``(read_id, seq)`` of FASTQ files: the second of every four non-blank lines.

    An incomplete or misplaced record fails the job. With ``on_bad="quarantine"`` such records are
    left out instead; ``fastq_faults`` returns their lines.
    """
    if on_bad not in ("fail", "quarantine"):
        raise ValueError("on_bad is fail or quarantine")
    lines = _fastq_lines(spark, paths)
    if on_bad == "quarantine":
        bad = fastq_faults(spark, paths).select("file", "read_id").distinct()
        lines = lines.join(bad, ["file", "read_id"], "left_anti")
        return lines.where("place = 1").select("read_id", normalise("text").alias("seq"))
    marked = ((F.col("place") == 0) & F.col("text").startswith("@")) | ((F.col("place") == 2) & F.col("text").startswith("+")) \
        | F.col("place").isin(1, 3)
    problem = F.concat("file", F.lit(": FASTQ record "), F.col("read_id").cast("string"), F.lit(" is incomplete or out of step"))
    # The check sits in the filter that every line passes, so no column pruning can skip it.
    sound = F.when(F.col("whole") & marked, F.col("place") == 1).otherwise(F.raise_error(problem).cast("boolean"))
    return lines.where(sound).select("read_id", normalise("text").alias("seq"))


def _checked(reads: DataFrame) -> DataFrame:
    problem = F.concat(F.lit("read "), F.col("read_id").cast("string"), F.lit(" has letters other than ACGT"))
    return reads.select(
        "read_id", F.when(is_dna("seq"), F.col("seq")).otherwise(F.raise_error(problem)).alias("seq")
    )


def invalid_reads(reads: DataFrame) -> DataFrame:
    """Reads with letters other than A, C, G and T."""
    return reads.where(~is_dna("seq"))


def read_reads(spark: SparkSession, paths: str | list[str], fmt: str | None = None, check: bool = True) -> DataFrame:
    """``(read_id, seq)`` of one or more inputs in order; the format is detected per input.

    With ``check``, reading a sequence with letters other than ACGT fails the job.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = [fmt or detect_format(spark, p) for p in paths]
    if len(set(kinds)) == 1 and kinds[0] in ("fasta", "fastq"):
        scan = scan_fasta if kinds[0] == "fasta" else scan_fastq
        reads = scan(spark, paths)
    else:
        reads = concat_reads([_read_one(spark, p, k) for p, k in zip(paths, kinds)])
    return _checked(reads) if check else reads


def _read_one(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "fasta":
        return scan_fasta(spark, path)
    if fmt == "fastq":
        return scan_fastq(spark, path)
    if fmt == "parquet":
        return spark.read.schema("read_id long, seq string").parquet(path)
    raise ValueError(f"format must be one of {FORMATS}")


def concat_reads(parts: list[DataFrame]) -> DataFrame:
    """Densely numbered read sets one after the other, numbered on. ``parts`` is a short list."""
    if len(parts) == 1:
        return parts[0]
    sizes = None
    for i, part in enumerate(parts):
        size = part.agg(F.count("*").alias("n")).select(F.lit(i).alias("part"), "n")
        sizes = size if sizes is None else sizes.unionByName(size)
    offsets = sizes.select("part", _before("n", Window.orderBy("part")).alias("offset"))
    tagged = None
    for i, part in enumerate(parts):
        rows = part.select(F.lit(i).alias("part"), "read_id", "seq")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    # One row per input.
    return tagged.join(F.broadcast(offsets), "part").select(
        (F.col("read_id") + F.col("offset")).alias("read_id"), "seq"
    )


def fasta_lines(reads: DataFrame) -> DataFrame:
    """``(read_id, record)``: FASTA text of each read, wrapped."""
    wrapped = F.regexp_replace("seq", f"(.{{{FASTA_WIDTH}}})(?=.)", "$1\n")
    name = F.concat(F.lit(">read_"), (F.col("read_id") + 1).cast("string"))
    return reads.select("read_id", F.concat_ws("\n", name, wrapped).alias("record"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """``(read_id, record)``: FASTQ text of each read with constant qualities."""
    name = F.concat(F.lit("@read_"), (F.col("read_id") + 1).cast("string"))
    quality = F.repeat(F.lit(FASTQ_QUALITY), F.length("seq"))
    return reads.select("read_id", F.concat_ws("\n", name, "seq", F.lit("+"), quality).alias("record"))


def write_reads(reads: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write a read set in the format given or named by the extension, in read order."""
    fmt = fmt or format_of_name(path)
    if fmt == "parquet":
        reads.select("read_id", "seq").write.parquet(path)
        return
    lines = fasta_lines(reads) if fmt == "fasta" else fastq_lines(reads)
    lines.orderBy("read_id").select("record").write.text(path)


def convert_reads(spark: SparkSession, inputs: list[str], output: str) -> None:
    """Join inputs of any format, in order, into one renumbered output."""
    write_reads(read_reads(spark, inputs), output)
