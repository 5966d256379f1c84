"""Stage tables that outlive their application, kept by what they were made from.

A stage is named by a key over the listing of the input files, the parameters it depends on, and its own
name. A finished stage leaves an entry in the manifest beside its table; a run that finds the entry reads the
table instead of computing it. Another input or parameter gives another key, so nothing stale is
served, and an interrupted run goes on after its last finished stage.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandweave.session import delete_path, path_exists, shared_root, write_small_file

# Part of every key: raise it when a stage's rows or columns change.
LAYOUT = 1


def listing_key(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the names, sizes and times of all input files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    seen = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"), "length").agg(
        F.count("*"), F.sum("h"), F.sum("length")).first()
    return hashlib.sha256(repr([str(x) for x in seen]).encode()).hexdigest()[:20]


class Store:
    """The stages of one input, below ``<root>/recipes``.

    ``root`` is the shared folder named by ``spark.checkpoint.dir`` unless given.
    """

    def __init__(self, spark: SparkSession, input_key: str, root: str | None = None):
        self.spark, self.input_key = spark, input_key
        self.root = f"{(root or shared_root(spark)).rstrip('/')}/recipes/{input_key}"

    def _place(self, stage: str, params: dict) -> tuple[str, str]:
        key = hashlib.sha256(json.dumps([LAYOUT, stage, params], sort_keys=True).encode()).hexdigest()[:16]
        return f"{self.root}/{stage}-{key}", f"{self.root}/manifest/{stage}-{key}.json"

    def find(self, stage: str, params: dict) -> DataFrame | None:
        """The table of a finished stage."""
        table, entry = self._place(stage, params)
        if not path_exists(self.spark, entry):
            return None
        schema = StructType.fromJson(json.loads(self.spark.read.text(entry, wholetext=True).first()[0])["schema"])
        return self.spark.read.schema(schema).parquet(table)

    def keep(self, stage: str, params: dict, df: DataFrame) -> DataFrame:
        """Write a stage, then its entry; what an interrupted run left is replaced."""
        table, entry = self._place(stage, params)
        df.write.mode("overwrite").parquet(table)
        about = {"stage": stage, "params": params, "input": self.input_key, "schema": df.schema.jsonValue()}
        write_small_file(self.spark, entry, json.dumps(about))
        return self.spark.read.schema(df.schema).parquet(table)

    def stages(self) -> DataFrame:
        """``(stage, params)`` of the manifest."""
        return self.spark.read.schema("stage string, params map<string, string>, input string").json(f"{self.root}/manifest").select(
            "stage", "params")

    def drop(self) -> None:
        """Delete everything kept for this input."""
        delete_path(self.spark, self.root)
