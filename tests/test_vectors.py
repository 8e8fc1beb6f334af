from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom import Params
from pairloom.functions.vectors import (
    PARTS,
    VECTOR,
    add_vectors,
    bucket_of,
    context_vector,
    degree_of_match,
    lookup,
    scaled_vector,
    signature,
    squared_norm,
    vector_total,
)

SEGMENT = ({"said": 1.0}, {",": 1 / 3, "based": 1 / 3, "in": 1 / 3}, {",": 0.25, "reported": 0.25, "earnings": 0.25, "today": 0.25})
X = {"x": 1.0}
HALVES = {"a": 0.5, "b": 0.5}
NO_LEFT = ({}, SEGMENT[1], SEGMENT[2])


def as_rows(v):
    return sorted(v.items())


def similarity(spark, p, c, p_tag="ORGANIZATION", c_tag="ORGANIZATION", params=Params()):
    columns = [f"{side}_{part}" for side in "pc" for part in PARTS]
    schema = "p_tag STRING, c_tag STRING, " + ", ".join(f"{x} {VECTOR}" for x in columns)
    df = spark.createDataFrame([(p_tag, c_tag, *map(as_rows, p), *map(as_rows, c))], schema)
    df = df.select("*", *(lookup(f"c_{x}").alias(f"m_{x}") for x in PARTS), *(squared_norm(f"c_{x}").alias(f"n_{x}") for x in PARTS))
    column = degree_of_match(
        "p_tag",
        tuple(f"p_{x}" for x in PARTS),
        "c_tag",
        tuple(f"m_{x}" for x in PARTS),
        tuple(f"n_{x}" for x in PARTS),
        params,
    )
    return df.select(column.alias("s")).first().s


@pytest.mark.parametrize(
    "p,c,expected",
    [
        (SEGMENT, SEGMENT, 0.902369),
        ((X, X, HALVES), (X, X, {"a": 1.0}), 0.833333),
        ((X, X, {"a": 1.0}), (X, X, HALVES), 0.859117),
        (NO_LEFT, NO_LEFT, 0.569036),
    ],
)
def test_degree_of_match_goldens(spark, p, c, expected):
    assert similarity(spark, p, c) == pytest.approx(expected, abs=1e-6)


def test_one_empty_context_is_null_not_nan(spark):
    assert similarity(spark, NO_LEFT, SEGMENT) is None
    assert similarity(spark, SEGMENT, NO_LEFT) is None


def test_orientation_mismatch_is_zero(spark):
    assert similarity(spark, SEGMENT, SEGMENT, c_tag="LOCATION") == 0.0
    assert similarity(spark, NO_LEFT, SEGMENT, c_tag="LOCATION") == 0.0


def test_plain_cosine(spark):
    assert similarity(spark, SEGMENT, SEGMENT, params=Params(plain_cosine=True)) == pytest.approx(1.0)


def test_self_similarity_per_signature():
    values = {s: round(Params().self_similarity(s), 6) for s in range(8)}
    assert values == {7: 0.902369, 6: 0.666667, 5: 0.569036, 3: 0.569036, 4: 0.333333, 2: 0.333333, 1: 0.235702, 0: 0.0}
    assert Params().joinable_signatures() == [3, 5, 6, 7]


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"], [])], "w ARRAY<STRING>, e ARRAY<STRING>")
    df = df.select(context_vector("w").alias("v"), context_vector("e").alias("z"))
    row = df.select(
        "v",
        "z",
        vector_total("v").alias("t"),
        squared_norm("v").alias("q"),
        add_vectors("v", "v").alias("twice"),
        scaled_vector("v").alias("scaled"),
        scaled_vector("z").alias("nothing"),
        signature("v", "z", "v").alias("s"),
    ).first()
    assert [tuple(x) for x in row.v] == [("a", 0.25), ("b", 0.5), ("c", 0.25)]
    assert row.z == [] and row.nothing == []
    assert (row.t, row.q, row.s) == (1.0, 0.375, 5)
    assert [tuple(x) for x in row.twice] == [("a", 0.5), ("b", 1.0), ("c", 0.5)]
    assert row.scaled == row.v


def test_buckets(spark):
    df = spark.createDataFrame([(0.04,), (0.05,), (0.95,), (1.0,), (None,)], "x DOUBLE")
    assert [r.b for r in df.select(bucket_of("x").alias("b")).collect()] == [0, 1, 10, 10, 0]


def test_params_are_checked():
    for wrong in (
        {"degree_of_match_threshold": 0},
        {"similarity_threshold": 0},
        {"cluster_mode": "other"},
        {"max_distance": 0},
        {"entity_tags": ("A", "A")},
    ):
        with pytest.raises(ValueError):
            Params(**wrong)
