from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import model
from pairloom import Params
from pairloom.functions.vectors import PARTS, VECTOR
from pairloom.operators import match
from pairloom.operators.match import match_contexts, pattern_index, score_contexts, similarity_counts
from pairloom.staging import stage
from test_cluster import random_patterns

SCHEMA = "id INT, left_tag STRING, " + ", ".join(f"{p} {VECTOR}" for p in PARTS)


def frame(spark, patterns, name):
    rows = [(i, p[0], *(sorted(v.items()) for v in p[1:])) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", name)


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.6, 0.85])
@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("words", ["abcd", "abcdefghijklmnop"])
def test_matches_equal_all_pairs(spark, threshold, plain, words):
    """The index leaves no pair out, whatever the threshold, and returns each once."""
    rng = random.Random(threshold)
    contexts = [p for p, _ in random_patterns(rng, 70, words)]
    patterns = [model.centroid([p] * 2 + [q]) if model.similarity(p, q) else p for (p, _), (q, _) in zip(random_patterns(rng, 40, words), random_patterns(rng, 40, words))]
    params = Params(plain_cosine=plain)
    table = frame(spark, patterns, "pattern_id")
    found = match_contexts(frame(spark, contexts, "c1"), table, pattern_index(table, threshold, params), threshold, params).collect()
    got = {(r.c1, r.pattern_id): round(r.similarity, 6) for r in found}
    assert len(got) == len(found)
    expected = {}
    for i, c in enumerate(contexts):
        for j, p in enumerate(patterns):
            s = model.similarity(c, p, plain)
            if s is not None and s >= threshold:
                expected[i, j] = round(s, 6)
    assert got == expected


@pytest.mark.parametrize("plain", [False, True])
def test_scores_equal_all_pairs(spark, plain):
    rng = random.Random(9)
    contexts = [p for p, _ in random_patterns(rng, 70, "abcdef")]
    patterns = [p for p, _ in random_patterns(rng, 40, "abcdef")]
    params = Params(plain_cosine=plain)
    scored = score_contexts(frame(spark, contexts, "c1"), frame(spark, patterns, "pattern_id"), params).collect()
    got = {(r.c1, r.pattern_id): round(r.similarity, 6) for r in scored}
    assert len(got) == len(scored)
    expected = {}
    for i, c in enumerate(contexts):
        for j, p in enumerate(patterns):
            s = model.similarity(c, p, plain)
            if s:
                expected[i, j] = round(s, 6)
    assert got == expected


def test_strict_threshold(spark):
    same = ("LOCATION", {"a": 1.0}, {"b": 1.0}, {})
    table = frame(spark, [same], "pattern_id")
    index = pattern_index(table, 2 / 3)
    for strict, n in ((False, 1), (True, 0)):
        assert match_contexts(frame(spark, [same], "c1"), table, index, 2 / 3, strict=strict).count() == n


def test_unreachable_signatures_are_not_indexed(spark):
    no_left = ("LOCATION", {}, {"b": 1.0}, {"c": 1.0})
    assert pattern_index(frame(spark, [no_left], "pattern_id"), 0.6).count() == 0


def test_common_tokens_stay_out_of_the_index(spark):
    patterns = [("LOCATION", {f"l{i}": 1.0}, {",": 0.5, f"m{i}": 0.5}, {".": 1.0}) for i in range(20)]
    index = pattern_index(frame(spark, patterns, "pattern_id"), 0.6)
    tokens = {r.feature for r in index.select("feature").distinct().collect()}
    assert "m:," not in tokens and "r:." not in tokens


def test_a_small_index_is_broadcast_and_each_pair_is_scored_once(spark):
    patterns = stage(frame(spark, [("LOCATION", {"a": 1.0}, {"b": 1.0}, {"c": 1.0})], "pattern_id"), "patterns")
    index = stage(pattern_index(patterns, 0.6), "index")
    contexts = stage(patterns.withColumnRenamed("pattern_id", "c1"), "contexts")
    plan = match_contexts(contexts, patterns, index, 0.6)._jdf.queryExecution()
    physical = plan.executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "Python" not in physical
    assert plan.optimizedPlan().toString().count("element_at(lc_map") == 1


def test_index_rows_grow_with_the_tokens_of_a_pattern(spark):
    """A pattern of five thousand tokens has a posting for each at most, and is matched."""
    tokens = {f"w{i:04d}": 1 / 5000 for i in range(5000)}
    patterns = frame(spark, [("LOCATION", tokens, {"in": 1.0}, {"x": 1.0}), ("LOCATION", {"w0007": 1.0}, {"in": 1.0}, {"y": 1.0})], "pattern_id")
    index = stage(pattern_index(patterns, 0.4), "index")
    assert index.count() <= 5005 and all(len(str(r)) < 250 for r in index.limit(20).collect())
    contexts = frame(spark, [("LOCATION", {"w0007": 0.5, "w4321": 0.5}, {"in": 1.0}, {"x": 1.0})], "c1")
    found = {r.pattern_id: r.similarity for r in match_contexts(contexts, patterns, index, 0.4).collect()}
    expected = [model.similarity(("LOCATION", {"w0007": 0.5, "w4321": 0.5}, {"in": 1.0}, {"x": 1.0}), ("LOCATION", t, {"in": 1.0}, r)) for t, r in ((tokens, {"x": 1.0}), ({"w0007": 1.0}, {"y": 1.0}))]
    assert found == {i: pytest.approx(s) for i, s in enumerate(expected) if s >= 0.4}


def test_bounds_settle_pairs_before_vectors_are_joined(spark):
    """Pairs that share an indexed token but cannot reach the threshold do not get to the vectors."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    contexts = frame(spark, [p for p, _ in random_patterns(rng, 80, words, empty=0)], "c1")
    patterns = frame(spark, [p for p, _ in random_patterns(rng, 80, words, empty=0)], "pattern_id")
    index = stage(pattern_index(patterns, 0.6), "index")
    sharing = match._units(contexts, ["c1"]).join(index, match._MEETING).select("c1", "pattern_id").distinct().count()
    candidates = match._candidates(contexts, index, 0.6, Params(), ["c1"], "pattern_id").count()
    matches = match_contexts(contexts, patterns, index, 0.6).count()
    assert matches <= candidates < 0.9 * sharing


@pytest.mark.parametrize("plain", [False, True])
def test_histogram_counts_equal_all_pairs(spark, plain, monkeypatch):
    """Small blocks, so that many meet; contexts stand for several segments each."""
    monkeypatch.setattr(match, "CONTEXT_BLOCK", 8)
    monkeypatch.setattr(match, "PATTERN_BLOCK", 5)
    rng = random.Random(21)
    contexts = [p for p, _ in random_patterns(rng, 150, "abcdefgh")]
    patterns = [p for p, _ in random_patterns(rng, 60, "abcdefgh")]
    weighted = frame(spark, contexts, "c1").withColumn("n", F.col("c1") % 4 + 1)
    got = {r.bucket: r.n for r in similarity_counts(weighted, frame(spark, patterns, "pattern_id"), Params(plain_cosine=plain)).collect()}
    expected = Counter()
    for i, c in enumerate(contexts):
        for p in patterns:
            expected[math.floor((model.similarity(c, p, plain) or 0.0) * 10 + 0.5)] += i % 4 + 1
    del expected[0]
    assert got == expected
    nothing = frame(spark, patterns, "pattern_id").limit(0)
    assert similarity_counts(weighted, nothing).count() == 0 and similarity_counts(weighted.limit(0), frame(spark, patterns, "pattern_id")).count() == 0


def test_a_token_in_every_context_weighs_on_no_single_block(spark, monkeypatch):
    monkeypatch.setattr(match, "CONTEXT_BLOCK", 64)
    contexts = frame(spark, [("LOCATION", {"the": 1.0}, {"x" + str(i): 1.0, "the": 1.0}, {}) for i in range(4000)], "c1").withColumn("n", F.lit(1))
    sizes = [len(r.rows) for r in match._blocks(contexts, match.CONTEXT_BLOCK, match._groups(contexts), *match.PARTS, "n").collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    patterns = frame(spark, [("LOCATION", {"the": 1.0}, {"the": 1.0}, {}) for _ in range(3)], "pattern_id")
    assert [tuple(r) for r in similarity_counts(contexts, patterns).collect()] == [(6, 12000)]


@pytest.mark.parametrize("plain", [False, True])
def test_wide_patterns_match_without_maps_of_their_vocabulary(spark, plain, monkeypatch):
    """Patterns beyond a width are met token by token, with the result of all pairs."""
    monkeypatch.setattr(match, "WIDE", 2)
    rng = random.Random(5)
    contexts = [p for p, _ in random_patterns(rng, 60, "abcdefgh")]
    patterns = [model.centroid([p] * 2 + [q]) if model.similarity(p, q) else p for (p, _), (q, _) in zip(random_patterns(rng, 40, "abcdefgh"), random_patterns(rng, 40, "abcdefgh"))]
    params = Params(plain_cosine=plain)
    table = stage(frame(spark, patterns, "pattern_id"), "patterns")
    matched = match_contexts(frame(spark, contexts, "c1"), table, pattern_index(table, 0.4, params), 0.4, params)
    got = {(r.c1, r.pattern_id): round(r.similarity, 6) for r in matched.collect()}
    pairs = {(i, j): model.similarity(c, p, plain) for i, c in enumerate(contexts) for j, p in enumerate(patterns)}
    assert got == {ij: round(s, 6) for ij, s in pairs.items() if s is not None and s >= 0.4}


def test_only_shared_tokens_of_a_pattern_come_to_a_context(spark):
    tokens = {f"w{i:04d}": 1 / 5000 for i in range(5000)}
    patterns = frame(spark, [("LOCATION", tokens, {"in": 1.0}, {})], "pattern_id").withColumn("loc", F.lit("x"))
    contexts = frame(spark, [("LOCATION", {"w0007": 0.5, "new": 0.5}, {"in": 1.0}, {"y": 1.0})], "c1").withColumn("loc", F.lit("x"))
    row = match.shared_weights(contexts, ["c1"], patterns, ["loc"], "pattern_id").first()
    assert (row.lc_map, row.mc_map, row.rc_map) == ({"w0007": 1 / 5000}, {"in": 1.0}, {})
