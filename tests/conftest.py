import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from strandweave import build_session

    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__default__parallelism="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
