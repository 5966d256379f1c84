"""Spark session defaults and the shared folder that long jobs use to cut lineage."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("strandweave")


def build_session(app: str = "strandweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. Every setting can be overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster a
    machine-local folder would vanish with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="strandweave-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same in every application."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return named or shared_dir(spark)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    system, place = _file_system(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


_scopes: list[list[str]] = []


@contextmanager
def dropped_rounds(spark: SparkSession) -> Iterator[None]:
    """Delete the loop rounds written inside once they are left; what is read later must be written apart."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def stage_path(spark: SparkSession, name: str) -> str:
    """Fresh path for one written table of this application below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}-stages/{name}-{uuid.uuid4().hex[:12]}"


# Spark's setting by which the shuffle files of one execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffle files, of no use beside the table, are deleted at once and not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    The copy outlives any executor. Unlike a checkpoint it also has a true size: a loop's
    size estimates would otherwise multiply from round to round, and joins with
    tables that turn out small could not be planned as such.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Continue from a written copy of ``df``; for the rounds of a loop."""
    spark = df.sparkSession
    path = stage_path(spark, "round")
    write_parquet(df, path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """Give a stored table at least one partition per core.

    Files below the split size arrive as a handful of partitions; they are small, so
    reshuffling them is cheap next to the work that follows. Larger tables already have
    more splits than cores and pass through unchanged.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union whose partition count does not grow when a loop applies it again and again."""
    width = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.unionByName(second).coalesce(width)
