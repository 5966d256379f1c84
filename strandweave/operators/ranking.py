"""Dense numbering and in-group ranks without a single-task sort.

A window over a whole table, or over one huge group, would run in one task. The
helpers work inside range partitions or hash buckets and add the offset of each, a running sum
over the table of their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import cut_lineage


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: 0-based position of each row in the order of the unique ``key``, however sparse."""
    return dense_order(df, [key], out)


def dense_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0-based position of each row in the order of any unique column list.

    Range partitioning on the full, unique key splits hot leading values. The ordered
    rows are written once so that their positions survive recomputation.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", 33)
    offsets = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", _running_offset("_n", Window.orderBy("_part")).alias("_offset")
    )
    # One row per partition, so the broadcast is bounded by the partition count.
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_slot", "_offset")
    )


def group_ranks(df: DataFrame, keys: list[str], order: str, out: str, buckets: int = 256) -> DataFrame:
    """Add ``out``: 0-based rank within each group of ``keys``.

    Rows of a group are ranked by (hash bucket of ``order``, ``order``). A group that
    holds much of the table is thereby ranked by many tasks.
    """
    parts = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = parts.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        *keys, "_bucket",
        _running_offset("_n", Window.partitionBy(*keys).orderBy("_bucket")).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    return (
        parts.withColumn("_local", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def _running_offset(count: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0))


def running_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: sum of ``value`` over all rows with a smaller unique ``key``.

    Range partitions are summed on their own and offset by the sums of those before; the rows are
    written once so that they keep their partition.
    """
    ranged = cut_lineage(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    offsets = ranged.groupBy("_part").agg(F.sum(value).alias("_n")).select(
        "_part", _running_offset("_n", Window.orderBy("_part")).alias("_offset")
    )
    local = _running_offset(value, Window.partitionBy("_part").orderBy(key))
    # One row per partition, so the broadcast is bounded by the partition count.
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )
