"""Removal of reads that lie wholly inside another read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.numeric import percent_of
from strandweave.operators.ranking import dense_ids


def with_lengths(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps with ``f_len`` and ``g_len``; the search already supplies them."""
    if {"f_len", "g_len"} <= set(overlaps.columns):
        return overlaps
    size = reads.select("read_id", F.length("seq").alias("n"))
    f = size.select(F.col("read_id").alias("f"), F.col("n").alias("f_len"))
    g = size.select(F.col("read_id").alias("g"), F.col("n").alias("g_len"))
    return overlaps.join(f, "f").join(g, "g")


def f_inside() -> Column:
    return (F.col("f_beg") == 0) & (F.col("f_end") == F.col("f_len") - 1)


def g_inside() -> Column:
    return (F.col("g_beg") == 0) & (F.col("g_end") == F.col("g_len") - 1)


def is_proper() -> Column:
    """Neither read lies wholly inside the other."""
    return ~f_inside() & ~g_inside()


def contained_reads(overlaps: DataFrame) -> DataFrame:
    """``(read_id)`` of contained reads. Of equal reads the highest id stays uncontained."""
    inside = F.when(f_inside(), F.col("f")).when(g_inside(), F.col("g"))
    return overlaps.select(inside.alias("read_id")).where(F.col("read_id").isNotNull()).distinct()


def old_to_new_indices(reads: DataFrame, contained: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: dense numbers of uncontained reads, null for contained ones."""
    ids = reads.select("read_id")
    kept = dense_ids(ids.join(contained, "read_id", "left_anti"), "read_id", "new_id")
    return ids.join(kept, "read_id", "left").select(F.col("read_id").alias("old_id"), "new_id")


def uncontained_reads(reads: DataFrame, index_map: DataFrame) -> DataFrame:
    kept = index_map.where(F.col("new_id").isNotNull())
    return reads.join(kept, reads["read_id"] == kept["old_id"]).select(
        F.col("new_id").alias("read_id"), "seq"
    )


def uncontained_overlaps(overlaps: DataFrame, index_map: DataFrame) -> DataFrame:
    """Overlaps between uncontained reads, both sides renumbered.

    A containing overlap always names a contained read, so those rows leave before the
    joins.
    """
    kept = index_map.where(F.col("new_id").isNotNull())
    f = kept.select(F.col("old_id").alias("f"), F.col("new_id").alias("f_new"))
    g = kept.select(F.col("old_id").alias("g"), F.col("new_id").alias("g_new"))
    rows = overlaps.where(is_proper()) if "f_len" in overlaps.columns else overlaps
    lens = [c for c in ("f_len", "g_len") if c in overlaps.columns]
    return rows.join(f, "f").join(g, "g").select(
        F.col("f_new").alias("f"), "f_beg", "f_end",
        F.col("g_new").alias("g"), "g_beg", "g_end", "rc", *lens,
    )


def containment_summary(index_map: DataFrame, overlaps: DataFrame, kept_overlaps: DataFrame) -> DataFrame:
    """One row of counts and percentages about reads and overlaps removed."""
    def tagged(df: DataFrame, **flags: Column) -> DataFrame:
        names = ("read", "contained", "overlap", "kept")
        return df.select(*[flags.get(n, F.lit(0)).alias(n) for n in names])

    rows = (
        tagged(index_map, read=F.lit(1), contained=F.col("new_id").isNull().cast("int"))
        .unionByName(tagged(overlaps, overlap=F.lit(1)))
        .unionByName(tagged(kept_overlaps, kept=F.lit(1)))
    )
    deleted = F.col("overlaps") - F.col("kept")
    return rows.agg(
        F.sum("read").alias("reads"), F.sum("contained").alias("contained_reads"),
        F.sum("overlap").alias("overlaps"), F.sum("kept").alias("kept"),
    ).select(
        "reads", "contained_reads",
        percent_of(F.col("contained_reads"), F.col("reads")).alias("contained_pct"),
        "overlaps", deleted.alias("deleted_overlaps"),
        percent_of(deleted, F.col("overlaps")).alias("deleted_pct"),
    )
