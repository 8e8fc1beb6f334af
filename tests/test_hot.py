"""Frequent keys: found by the sketch, joined with equal results, and dealt evenly."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import score, segments
from pairloom.operators.hot import hot_keys, spread_join


@pytest.fixture()
def shuffled(spark):
    """Shuffle joins of eight partitions, as planned."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def mentioned(spark, n=40_000):
    """A third of the rows has one organization, another third one context."""
    org = F.when(F.col("id") % 3 == 0, "Acme").otherwise(F.concat(F.lit("org"), F.col("id") % 997))
    c1 = F.when(F.col("id") % 3 == 1, -7).otherwise(F.col("id") % 4999).cast("long")
    rows = spark.range(n).select(org.alias("org"), F.concat(F.lit("loc"), F.col("id") % 5).alias("loc"), c1.alias("c1"), (F.col("id") % 2).alias("c2"), (F.col("id") % 4 + 1).alias("n"))
    return rows.unionByName(spark.createDataFrame([(None, "x", None, 0, 1)], rows.schema))


def test_frequent_keys_are_found(shuffled):
    rows = mentioned(shuffled)
    found = hot_keys(rows, "org", "c1").first()
    assert [(x["item"], x["pieces"]) for x in found["org"]] == [("Acme", 3)]
    assert [(x["item"], x["pieces"]) for x in found["c1"]] == [(-7, 3)]
    assert [x["pieces"] for x in hot_keys(rows, "org", partitions=200).first()["org"]] == [67]
    assert hot_keys(rows.limit(0), "org", "c1").first().asDict() == {"org": [], "c1": []}


def per_partition(df):
    return sorted(Counter(r[0] for r in df.select(F.spark_partition_id()).collect()).values())


def test_rows_of_a_hot_key_are_dealt_evenly(shuffled):
    rows = mentioned(shuffled)
    seeds = shuffled.createDataFrame([("Acme", "loc1"), ("Acme", "loc2"), *((f"org{i}", "loc0") for i in range(997))], "org STRING, seed_loc STRING")
    hot = hot_keys(rows, "org", partitions=64)
    plain, spread = spread_join(rows, seeds, ["org"], None, "org"), spread_join(rows, seeds, ["org"], hot, "org")
    assert spread.columns == plain.columns
    assert plain.exceptAll(spread).count() == 0 and spread.exceptAll(plain).count() == 0
    before, after = per_partition(plain), per_partition(spread)
    assert before[-1] > 3 * before[len(before) // 2]
    assert after[-1] < 1.6 * after[len(after) // 2]


def test_scores_are_those_of_plain_joins(shuffled):
    rows = mentioned(shuffled, 6_000)
    chance = random.Random(3)
    seeds = shuffled.createDataFrame([("Acme", "loc1"), ("Acme", "loc1"), ("Acme", "loc3"), ("org5", "loc0"), (None, "loc0")], "org STRING, loc STRING")
    contexts = rows.select("c1", "c2").distinct().where("c1 IS NOT NULL").orderBy("c1", "c2").collect()
    matches = shuffled.createDataFrame([(*c, p, chance.random()) for c in contexts for p in range(2)], "c1 LONG, c2 LONG, pattern_id INT, similarity DOUBLE")
    confidence = shuffled.createDataFrame([(0, 0.5), (1, 0.75)], "pattern_id INT, confidence DOUBLE")
    best = score.best_pattern(matches)
    hot = hot_keys(rows, "org", "c1", partitions=16)
    for plain, dealt in (
        (score.label_contexts(rows, seeds), score.label_contexts(rows, seeds, hot)),
        (score.pattern_matches(rows, matches), score.pattern_matches(rows, matches, hot)),
        (score.match_seed_join(rows, seeds), score.match_seed_join(rows, seeds, hot)),
        (score.candidate_tuples(rows, best, confidence), score.candidate_tuples(rows, best, confidence, hot)),
    ):
        assert plain.columns == dealt.columns and plain.count() > 0
        assert plain.exceptAll(dealt).count() == 0 and dealt.exceptAll(plain).count() == 0


def test_raw_patterns_are_those_of_a_plain_join(shuffled):
    words = F.array(F.concat(F.lit("w"), (F.col("n") % 3).cast("string")))
    rows = mentioned(shuffled, 3_000).select("org", "loc", F.lit("ORGANIZATION").alias("left_tag"), *(words.alias(w) for w in ("lw", "mw", "rw")), F.col("n").alias("weight"))
    seeds = shuffled.createDataFrame([("Acme", "loc1"), ("Acme", "loc1"), ("Acme", "loc3"), ("org5", "loc0")], "org STRING, loc STRING")
    hot = hot_keys(rows, "org", partitions=16)
    plain, dealt = (sorted(map(repr, segments.raw_patterns(rows, seeds, h).collect())) for h in (None, hot))
    assert plain and plain == dealt
