"""Folding of identical and reverse-complement reads.

All pairs of copies overlap, so a read present m times adds m * m / 2 overlaps that say
nothing new. The assembly searches one read per distinct sequence, the copy with the
highest id, which is the one that stays when contained reads are removed. What the graph
needs to know of the other copies, where they lie in uncontained reads, follows from
the placements of that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import reverse_complement
from strandweave.operators.mapping import PLACEMENT

SALTS = 16


def _canonical(reads: DataFrame) -> DataFrame:
    both = F.least(F.col("seq"), reverse_complement("seq"))
    return reads.select("read_id", both.alias("key"), (F.col("seq") != both).alias("flip"))


def _digest() -> list[Column]:
    return [F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2")]


def read_groups(reads: DataFrame) -> DataFrame:
    """``(read_id, seq, flip, copies)``: one read per distinct sequence, and how many reads have it.

    ``flip`` tells that the read is the greater of its two strands. The
    grouping keeps one row per sequence and partition before the exchange, so a sequence that
    makes up much of the input costs no more than any other.
    """
    groups = _canonical(reads).groupBy("key").agg(
        F.max(F.struct("read_id", "flip")).alias("rep"), F.count("*").alias("copies"))
    return groups.select(
        F.col("rep.read_id").alias("read_id"),
        F.when(F.col("rep.flip"), reverse_complement("key")).otherwise(F.col("key")).alias("seq"),
        F.col("rep.flip").alias("flip"), "copies",
    )


def copies_of(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """``(read_id, rep, flipped)`` of the reads that do not stand for their group.

    ``flipped`` tells that a copy is the reverse complement of its representative.
    """
    # Copies are found again by two hashes of the sequence; text stays out of the join, and a sequence
    # that makes up much of the input is spread over SALTS tasks.
    keyed = _canonical(reads)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    key = F.when(F.col("flip"), reverse_complement("seq")).otherwise(F.col("seq"))
    repeated = groups.where(F.col("copies") > 1).select(
        key.alias("key"), F.struct("read_id", "flip").alias("rep")).select(*_digest(), "rep", salt.alias("salt"))
    narrow = keyed.select(*_digest(), "read_id", "flip", F.pmod("read_id", F.lit(SALTS)).cast("int").alias("salt"))
    return narrow.join(repeated, ["h1", "h2", "salt"]).where(F.col("read_id") != F.col("rep.read_id")).select(
        "read_id", F.col("rep.read_id").alias("rep"), (F.col("flip") != F.col("rep.flip")).alias("flipped"))


def fold_copies(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct reads ``(read_id, seq)`` and the others ``(read_id, rep, flipped)``."""
    groups = read_groups(reads)
    return groups.select("read_id", "seq"), copies_of(reads, groups)


def copy_placements(copies: DataFrame, placements: DataFrame, index_map: DataFrame) -> DataFrame:
    """Placements of copies, given those of their representatives.

    An uncontained representative is itself the container of its copies. Otherwise a copy
    lies wherever its representative does; which of several offsets in one container counts,
    and the order among containers, depend on the copy's own id.
    """
    itself = index_map.where(F.col("new_id").isNotNull()).select(
        F.col("old_id").alias("rep"), F.col("old_id").alias("container"), F.col("new_id").alias("read"),
        F.lit(0).alias("before"), F.lit(0).alias("after"), F.lit(False).alias("rc"))
    of_rep = placements.select(
        F.col("read_id").alias("rep"), "container", "read", "before", "after", "rc").unionByName(itself)
    first = F.col("read_id") < F.col("container")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = of_rep.join(copies.select("rep").distinct(), "rep").withColumn("salt", salt)
    salted = copies.withColumn("salt", F.pmod("read_id", F.lit(SALTS)).cast("int"))
    placed = salted.join(spread, ["rep", "salt"]).select(
        "read_id", "container", "read", "before", "after",
        (F.col("rc") != F.col("flipped")).alias("rc"),
        (~first & (F.col("before") > 0)).alias("later"),
    )
    return (
        placed.groupBy("read_id", "container", "read", "rc", "later")
        .agg(F.min(F.struct("before", "after")).alias("at"))
        .select(
            "read_id", "container", "read", F.col("at.before").alias("before"), F.col("at.after").alias("after"),
            "rc", F.least("read_id", "container").alias("f"), F.greatest("read_id", "container").alias("g"),
            (F.col("later").cast("int") * 2 + F.col("rc").cast("int")).alias("type"),
        )
        .select(*PLACEMENT)
    )
