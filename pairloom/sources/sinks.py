"""Result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _replace(df: DataFrame, path: str, format: str) -> None:
    """Write to a folder beside ``path`` and move it there once it is whole.

    What is there stays until the new result is complete, and comes back if the
    last move fails; a failing job leaves it as it was. The file system of the
    path moves the folders, so this is a rename wherever that has one.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    version = uuid.uuid4().hex
    base = path.rstrip("/")
    goal, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (base, f"{base}.{version}.new", f"{base}.{version}.old"))
    files = goal.getFileSystem(conf)
    try:
        df.write.format(format).save(new.toString())
        there = files.exists(goal)
        if there and not files.rename(goal, old):
            raise OSError(f"cannot move {base} aside")
        if not files.rename(new, goal):
            if there:
                files.rename(old, goal)
            raise OSError(f"cannot move the result to {base}")
    finally:
        files.delete(new, True)
    files.delete(old, True)


def format_relations(relations: DataFrame) -> DataFrame:
    """``(org, loc)`` as text lines of the form ``(org,loc)``."""
    return relations.select(F.concat(F.lit("("), "org", F.lit(","), "loc", F.lit(")")).alias("line"))


def write_relations(relations: DataFrame, path: str, format: str = "text") -> None:
    """Write pairs as ``(org,loc)`` lines or as a columnar table, replacing what is there."""
    out = format_relations(relations) if format == "text" else relations.select("org", "loc")
    _replace(out, path, format)


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write statistics or tagged text, replacing what is there.

    As text, a row becomes ``(first,second,...)``; a single column is written bare.
    """
    if format == "text":
        fields = [F.col(c).cast("string") for c in df.columns]
        line = fields[0] if len(fields) == 1 else F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))
        df = df.select(line.alias("line"))
    _replace(df, path, format)
