import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"

#: Null, empty, tiny, letterless, repeated and long texts; ids that are null, repeated and tied.
ODD_DOCS = [
    (1, None, "en"), (2, "", "en"), (3, "a", None), (4, "?! 12 ...", "en"), (5, "one two three four", "en"),
    (6, "one two three four five six seven eight nine ten eleven", "en"),
    (7, "one two three four five six seven eight nine ten eleven", "en"),
    (7, "one two three four five six seven eight nine ten eleven", "en"),
    (7, "another text under the same id as the one before it, by mistake", "en"),
    (None, "a text without any id at all, five words and more", "en"), (None, None, None),
    (8, "Émile Zola écrit\nà côté <|endoftext|> of the sea   ǅ 中文", "fr"), (9, "word " * 40000, "en"),
]


@pytest.fixture(scope="session")
def spark():
    from strandweave import build_session

    session = build_session(
        "llm-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__default__parallelism="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("row", "key", "score", "cid", "label", "sign", "text_hash", "_rows", "_id", "task", "first", "ids",
                 "bucket", "_bucket", "_order", "_tokens", "_rate", "n_rows", "block", "words", "domain",
                 "_dropped", "_again", "_copy", "_copies", "_hash", "_id_again", "_cell"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
