from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    from pairloom.staging import session_builder

    session = (
        session_builder("pairloom-tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.ui.enabled", "false")
        # Tests add up the bytes of all stages; a session forgets the oldest beyond this number, with or without its web page.
        .config("spark.ui.retainedStages", "1000000")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def sentences(spark):
    """A factory: texts to ``(sentence_id, sentence)``."""

    def make(*texts: str):
        rows = [(f"s{i:04d}", t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "sentence_id STRING, sentence STRING")

    return make


@pytest.fixture()
def seeds(spark):
    def make(*pairs: tuple[str, str]):
        return spark.createDataFrame(list(pairs), "org STRING, loc STRING")

    return make
