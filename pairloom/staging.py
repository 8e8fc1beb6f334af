"""Session settings and tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session_builder(app_name: str = "pairloom") -> SparkSession.Builder:
    """A builder with the settings the operators are tuned for; master and memory are the caller's."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    return builder


# Folders of local sessions, removed when the process ends.
_local_folders: list[tempfile.TemporaryDirectory] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; on a
    cluster that would lose data with its machine, so there it is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local_folders.append(tempfile.TemporaryDirectory(prefix="pairloom-", ignore_cleanup_errors=True))
        context.setCheckpointDir(_local_folders[-1].name)
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/pairloom-{context.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer the
    table's real size, so that joins with a small stage become broadcast joins
    and joins with a large one do not.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_stage(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`stage`, with sums over the rows that are gathered while they are written. A sum over no rows is 0."""
    observation = Observation()
    written = stage(df.observe(observation, *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(k) for k, c in totals.items())), name)
    return written, observation.get
