"""DNA read sets derived from the relational test tables, all of it inside Spark.

``part`` supplies the genome, 32 bases per row, and ``events`` one sampled read per
row. The genome is never gathered into one value: rows are cut into overlapping tiles
and each read joins the single tile it starts in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.sequence import BASES, reverse_complement

# Fixed values of the derivation: hex digits to bases, block and read geometry, overlap length.
HEX_DIGITS = "0123456789abcdef"
HEX_BASES = BASES * 4
BLOCK_LEN = 32
READ_LEN_MIN = 80
READ_LEN_SPREAD = 41
READ_TABLES = ("part", "events")
MIN_OVERLAP_LEN = 40


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def genome_blocks(part: DataFrame) -> DataFrame:
    """``(block_no, bases)``: block_no is the dense part key, bases its 32 letters."""
    key = F.col("p_partkey")
    repeat = (key % 1000).between(100, 104) | (key % 1000).between(150, 154)
    label = F.when(
        repeat,
        F.concat(F.lit("r"), F.floor(key / 1000).cast("string"), F.lit("_"), (key % 50).cast("string")),
    ).otherwise(F.concat(F.lit("g"), key.cast("string")))
    return part.select(
        key.alias("block_no"),
        F.translate(F.md5(label.cast("binary")), HEX_DIGITS, HEX_BASES).alias("bases"),
    )


def genome_tiles(blocks: DataFrame, span: int) -> DataFrame:
    """``(block_no, tile)``: the block's bases followed by those of the next ``span - 1`` blocks."""
    spread = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(span - 1))).alias("shift"), "block_no", "bases"
    ).select((F.col("block_no") - F.col("shift")).alias("block_no"), "shift", "bases")
    return (
        spread.where(F.col("block_no") >= 0)
        .groupBy("block_no")
        .agg(F.array_sort(F.collect_list(F.struct("shift", "bases"))).alias("pieces"))
        .where(F.col("pieces")[0]["shift"] == 0)
        .select("block_no", F.array_join(F.col("pieces")["bases"], "").alias("tile"))
    )


def _digest(tag: str, key: Column) -> Column:
    text = F.concat(F.lit(tag), key.cast("string")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def read_layout(events: DataFrame, part: DataFrame) -> DataFrame:
    """``(read_id, start, read_len, flipped)``: where each read comes from."""
    genome_len = F.lit(part.count() * BLOCK_LEN)
    key = F.col("event_id")
    read_len = (READ_LEN_MIN + _digest("l", key) % READ_LEN_SPREAD).cast("int")
    return events.select(
        key.alias("read_id"),
        (_digest("p", key) % (genome_len - read_len + 1)).alias("start"),
        read_len.alias("read_len"),
        (_digest("s", key) % 2 == 1).alias("flipped"),
    )


def sampled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(read_id, seq)`` for every event row."""
    part = load(spark, sf_dir, "part").select("p_partkey")
    events = load(spark, sf_dir, "events").select("event_id")
    span = -(-(READ_LEN_MIN + READ_LEN_SPREAD - 1 + BLOCK_LEN - 1) // BLOCK_LEN)
    tiles = genome_tiles(genome_blocks(part), span)
    placed = read_layout(events, part).withColumn(
        "block_no", F.floor(F.col("start") / BLOCK_LEN).cast("long")
    )
    window = F.substring(
        F.col("tile"), (F.col("start") % BLOCK_LEN + 1).cast("int"), F.col("read_len")
    )
    return placed.join(tiles, "block_no").select(
        "read_id", F.when(F.col("flipped"), reverse_complement(window)).otherwise(window).alias("seq")
    )
