from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.sources import (
    format_relations,
    parse_articles,
    parse_seeds,
    read_lines,
    rejected_articles,
    write_relations,
    write_table,
)
from pairloom.staging import stage, staging_root


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line STRING")


def test_reading_several_paths_keeps_every_line(spark, tmp_path):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("a\nb\n")
    two.write_text("b\n")
    read = read_lines(spark, [str(one), str(two), str(one)])
    assert sorted(r.line for r in read.collect()) == ["a", "a", "b", "b", "b"]
    assert sorted(r.line for r in read_lines(spark, [str(one), str(two)]).collect()) == ["a", "b", "b"]
    assert read_lines(spark, str(two)).count() == 1
    with pytest.raises(ValueError):
        read_lines(spark, [])


GOOD = ["1\ta\tb\tc\ttext", "+2\t\t\t\tx\ty", "-3\ta\tb\tc\t t "]
BAD = ["x\ta\tb\tc\ttext", "4\ta\tb\tc", "5\ta\tb\tc\t\t\t", " 6\ta\tb\tc\tt", "99999999999999999999\ta\tb\tc\tt", ""]


def test_articles(spark):
    df = lines(spark, *GOOD, *BAD)
    assert [tuple(r) for r in parse_articles(df).collect()] == [(1, "text"), (2, "x"), (-3, " t ")]
    assert [r.line for r in rejected_articles(df).collect()] == BAD
    assert parse_articles(lines(spark, *GOOD), strict=True).count() == 3
    with pytest.raises(Exception, match="malformed article line"):
        parse_articles(df, strict=True).collect()


def test_seeds(spark):
    df = lines(spark, "A\tR", "A\tR\textra", "B C\tS T", "broken")
    assert [tuple(r) for r in parse_seeds(df).collect()] == [("A", "R"), ("A", "R"), ("B C", "S T")]


def test_relations_are_written_as_tuples_and_replace_older_ones(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "R"), ("B", "S")], "org STRING, loc STRING")
    assert [r.line for r in format_relations(pairs).collect()] == ["(A,R)", "(B,S)"]
    out = str(tmp_path / "out")
    write_relations(pairs, out)
    write_relations(pairs.where("org = 'B'"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["(B,S)"]
    write_relations(pairs, out, format="parquet")
    assert spark.read.parquet(out).count() == 2


def test_statistics_are_written(spark, tmp_path):
    df = spark.createDataFrame([("w", "T", 3)], "word STRING, tag STRING, n BIGINT")
    write_table(df, str(tmp_path / "t"), format="text")
    assert spark.read.text(str(tmp_path / "t")).first().value == "(w,T,3)"
    write_table(df.select("word"), str(tmp_path / "t"), format="text")
    assert spark.read.text(str(tmp_path / "t")).first().value == "w"
    write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().n == 3


def test_stages_live_in_the_shared_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert staging_root(spark).startswith(folder)
    staged = stage(spark.range(3), "numbers")
    assert staged.count() == 3 and all(folder in f for f in staged.inputFiles())


def test_large_article_numbers_are_kept(spark):
    from pairloom.sources import parse_articles

    lines = spark.createDataFrame([("3000000000\ta\tb\tc\ttext",)], "line STRING")
    assert [tuple(r) for r in parse_articles(lines).collect()] == [(3000000000, "text")]


def test_a_failing_job_leaves_the_old_output_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "word STRING, n INT")
    write_table(rows, path)
    failing = rows.withColumn("n", F.when(F.col("word") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="no"):
        write_table(failing, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2)]
    write_table(rows.where("n = 2"), path + "/")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("b", 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
