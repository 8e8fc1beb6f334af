"""Line sources: text files, tab-separated articles and tab-separated seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_FIELD = 0
TEXT_FIELD = 4


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of all paths as ``(line)``; a path given twice is read twice."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("at least one input path is needed")
    if len(set(paths)) == len(paths):
        return spark.read.text(paths).withColumnRenamed("value", "line")
    return union_lines(*(spark.read.text(path).withColumnRenamed("value", "line") for path in paths))


def union_lines(*inputs: DataFrame) -> DataFrame:
    """Bag union of line sets."""
    return reduce(DataFrame.unionByName, inputs)


def _fields(line: str) -> Column:
    # Trailing empty fields do not count as fields.
    return F.split(F.regexp_replace(line, r"\t+\z", ""), "\t")


def _article_columns(lines: DataFrame) -> DataFrame:
    # The filters below would otherwise cut each line into fields once more.
    split_once = lines.select("line", F.explode_outer(F.array(_fields("line"))).alias("fields"))
    index = F.get("fields", F.lit(INDEX_FIELD))
    return split_once.select(
        "line",
        F.when(index.rlike(r"\A[+-]?[0-9]+\z"), index.try_cast("bigint")).alias("index"),
        F.get("fields", F.lit(TEXT_FIELD)).alias("text"),
    )


def parse_articles(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(line)`` to ``(index, text)`` from tab-separated fields 0 and 4.

    Strict mode fails the job at the first malformed line; otherwise malformed
    lines are left out here and returned whole by :func:`rejected_articles`.
    """
    parsed = _article_columns(lines)
    if strict:
        broken = F.raise_error(F.concat(F.lit("malformed article line: "), F.col("line")))
        good = F.col("index").isNotNull() & F.col("text").isNotNull()
        return parsed.select(
            F.when(good, F.col("index")).otherwise(broken.cast("bigint")).alias("index"),
            F.when(good, F.col("text")).otherwise(broken.cast("string")).alias("text"),
        )
    return parsed.where(F.col("index").isNotNull() & F.col("text").isNotNull()).select("index", "text")


def rejected_articles(lines: DataFrame) -> DataFrame:
    """The lines :func:`parse_articles` leaves out."""
    return _article_columns(lines).where(F.col("index").isNull() | F.col("text").isNull()).select("line")


def parse_seeds(lines: DataFrame) -> DataFrame:
    """``(line)`` to ``(org, loc)`` from fields 0 and 1; further fields are ignored, duplicates kept."""
    fields = _fields("line")
    return lines.select(
        F.get(fields, F.lit(0)).alias("org"),
        F.get(fields, F.lit(1)).alias("loc"),
    ).where(F.col("org").isNotNull() & F.col("loc").isNotNull())
