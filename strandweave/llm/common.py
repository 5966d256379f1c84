"""What the operators share: reading tables, fold columns, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRAIN = 1 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def thinned(df: DataFrame, share: Column | float) -> DataFrame:
    """Rows whose hash of ``doc_id`` falls below ``share``: the same rows in every run."""
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit("thinned")), F.lit(_GRAIN)) < F.lit(_GRAIN) * share)


def bounded_sample(df: DataFrame, by: str, rows: int) -> DataFrame:
    """About ``rows`` rows per value of ``by`` at most, chosen by a hash of ``doc_id``.

    All rows are kept where a value has fewer. Only for fitting classifiers; the counts
    are one grouped sum whose result has a row per class.
    """
    shares = [(r[0], min(1.0, rows / r[1])) for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()]
    if not shares:
        return df.where("false")
    share = F.coalesce(*[F.when(F.col(by) == value, F.lit(part)) for value, part in shares])
    return thinned(df, share)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
