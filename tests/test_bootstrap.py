from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import model
from conftest import TINY
from pairloom import Params
from pairloom.operators import prepare, score
from pairloom.operators.cluster import cluster_patterns
from pairloom.operators.segments import mentions, raw_patterns
from pairloom.plans import Round, bootstrap_relations, prepare_mentions
from pairloom.plans.bootstrap import METRICS
from pairloom.workload import corpus


def a(org, loc):
    return f"said <ORGANIZATION>{org}</ORGANIZATION> , based in <LOCATION>{loc}</LOCATION> , reported earnings today"


def c(org, loc):
    return f"yesterday <ORGANIZATION>{org}</ORGANIZATION> shipped goods to <LOCATION>{loc}</LOCATION> by rail"


TEXTS = (
    [a("Acme", "Rome")] * 4
    + [a("Bolt", "Oslo")] * 3
    + [a("Cato", "Lima")] * 2
    + [a("Dune", "Bern")]
    + [c("Acme", "Oslo")] * 2
    + [a("Bolt", "Rome")]
    + [a("Cato", "Oslo")] * 2
)
SEEDS = [("Acme", "Rome"), ("Bolt", "Oslo")]


def metrics_of(extraction):
    return [tuple(r[m] for m in METRICS) for r in extraction.metrics.orderBy("iteration").collect()]


def pairs_of(df):
    return sorted((r.org, r.loc) for r in df.collect())


@pytest.fixture(scope="module")
def two_rounds(spark):
    rows = [(str(i), t) for i, t in enumerate(TEXTS)]
    return bootstrap_relations(
        spark.createDataFrame(rows, "sentence_id STRING, sentence STRING"),
        spark.createDataFrame(SEEDS, "org STRING, loc STRING"),
        Params(iterations=2),
    )


def test_two_round_golden(two_rounds):
    #            raw, centroids, final, segments, candidates, new, total
    assert metrics_of(two_rounds) == [(7, 1, 1, 15, 13, 3, 3), (9, 1, 1, 15, 13, 2, 3)]
    assert pairs_of(two_rounds.relations) == [("Acme", "Rome"), ("Bolt", "Oslo"), ("Cato", "Lima")]


def test_confidences_golden(two_rounds):
    first, second = two_rounds.rounds
    row = first.confidence.first()
    assert (row.positives, row.negatives, row.confidence) == (7, 1, 0.875)
    got = {(r.org, r.loc): round(r.confidence, 6) for r in first.tuples.collect()}
    assert got == {
        ("Acme", "Rome"): 0.998039,
        ("Bolt", "Oslo"): 0.990682,
        ("Cato", "Lima"): 0.955720,
        ("Cato", "Oslo"): 0.955720,
        ("Dune", "Bern"): 0.789573,
        ("Bolt", "Rome"): 0.789573,
    }
    row = second.confidence.first()
    assert (row.positives, row.negatives, row.confidence) == (9, 3, 0.75)
    got = {(r.org, r.loc): round(r.confidence, 6) for r in second.tuples.collect()}
    assert got["Cato", "Lima"] == 0.895527  # below the threshold now, yet still a known pair


def test_model_agrees_with_the_goldens():
    seeds, metrics, _, _ = model.extract(TEXTS, SEEDS, iterations=2)
    assert metrics == [(7, 1, 1, 15, 13, 3, 3), (9, 1, 1, 15, 13, 2, 3)]
    assert seeds == [("Acme", "Rome"), ("Bolt", "Oslo"), ("Cato", "Lima")]


def test_several_known_locations(sentences, seeds):
    texts = [a("Acme", "Rome")] * 6
    extraction = bootstrap_relations(sentences(*texts), seeds(("Acme", "Rome"), ("Acme", "Oslo")))
    row = extraction.rounds[0].confidence.first()
    assert (row.positives, row.negatives, row.confidence) == (6, 6, 0.5)
    assert round(extraction.rounds[0].tuples.first().confidence, 6) == 0.972675
    assert pairs_of(extraction.relations) == [("Acme", "Oslo"), ("Acme", "Rome")]


@pytest.mark.parametrize("copies,patterns", [(6, 1), (5, 0)])
def test_cluster_size_is_strict(sentences, seeds, copies, patterns):
    extraction = bootstrap_relations(sentences(*[a("Acme", "Rome")] * copies), seeds(("Acme", "Rome")))
    assert metrics_of(extraction)[0][2] == patterns


def test_duplicate_seeds_count_twice_in_the_first_round_only(sentences, seeds):
    texts, doubled = [a("Acme", "Rome")] * 3, [("Acme", "Rome"), ("Acme", "Rome")]
    kept = bootstrap_relations(sentences(*texts), seeds(*doubled), Params(iterations=2))
    assert [m[0] for m in metrics_of(kept)] == [6, 3]
    once = bootstrap_relations(sentences(*texts), seeds(*doubled), Params(dedup_seeds=True))
    assert [m[0] for m in metrics_of(once)] == [3]


def test_empty_inputs(sentences, seeds, spark):
    none = spark.createDataFrame([], "org STRING, loc STRING")
    extraction = bootstrap_relations(sentences(*TEXTS), none)
    assert metrics_of(extraction) == [(0, 0, 0, 15, 0, 0, 0)]
    extraction = bootstrap_relations(sentences("nothing here"), seeds(*SEEDS))
    assert metrics_of(extraction) == [(0, 0, 0, 0, 0, 0, 2)]


def test_early_stop_repeats_nothing(sentences, seeds):
    params = Params(iterations=5, early_stop=True)
    extraction = bootstrap_relations(sentences(*TEXTS), seeds(*SEEDS), params)
    # Round 2 starts from three pairs and adds none.
    assert len(metrics_of(extraction)) == 2
    assert len(pairs_of(extraction.relations)) == 3


@pytest.fixture(scope="module")
def rendered(spark):
    return corpus.tagged_sentences(spark, TINY)


@pytest.fixture(scope="module")
def known(spark, rendered):
    """The suppliers of the recorded example runs."""
    every_fifth = corpus.table(spark, TINY, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_name").alias("org"))
    return corpus.supplier_nations(spark, TINY).join(every_fifth, "org").select("org", "loc")


def test_rendered_corpus_goldens(spark, rendered, known):
    assert rendered.count() == 6000 and rendered.select("sentence_id").distinct().count() == 6000
    # The recorded runs are single passes: one level-1 bucket.
    extraction = bootstrap_relations(rendered, known, Params(iterations=3, buckets=1, side_buckets=1))
    assert metrics_of(extraction) == [
        (491, 6, 5, 4207, 3009, 10, 10),
        (2541, 6, 6, 4207, 3607, 10, 10),
        (2541, 6, 6, 4207, 3607, 10, 10),
    ]
    sizes = [r["size"] for r in extraction.rounds[0].level1.orderBy(F.desc("size")).collect()]
    assert sizes == [120, 117, 115, 113, 24, 2]
    confidences = sorted(
        (r.positives, r.negatives, round(r.confidence, 6)) for r in extraction.rounds[1].confidence.collect()
    )
    assert confidences == [(18, 580, 0.0301), (50, 1136, 0.042159), (577, 0, 1.0), (622, 0, 1.0), (624, 0, 1.0)]
    truth = set(pairs_of(corpus.supplier_nations(spark, TINY)))
    assert set(pairs_of(extraction.relations)) <= truth


def test_rendered_corpus_exact_goldens(rendered, known):
    extraction = bootstrap_relations(rendered, known, Params(cluster_mode="exact"))
    assert metrics_of(extraction) == [(491, 148, 8, 4207, 3009, 10, 10)]
    step = extraction.rounds[0]
    assert step.corpus.contexts.count() <= 269 and step.tuples.count() == 217


def test_rendered_corpus_equals_the_sequential_model(rendered, known):
    texts = [r.sentence for r in rendered.orderBy("sentence_id").collect()]
    seeds, metrics, confidences, _ = model.extract(texts, pairs_of(known))
    extraction = bootstrap_relations(rendered, known, Params(buckets=1, side_buckets=1))
    assert metrics_of(extraction) == metrics
    assert pairs_of(extraction.relations) == seeds
    got = {(r.org, r.loc): r.confidence for r in extraction.rounds[0].tuples.collect()}
    assert set(got) == set(confidences)
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in confidences.items())
    assert all(0 <= v <= 1 and not math.isnan(v) for v in got.values())


def test_result_does_not_depend_on_partitions(spark, rendered, known):
    results = []
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            params = Params()
            step = Round(prepare_mentions(rendered.repartition(int(partitions)), params), known, params)
            patterns = sorted((r.pattern_id, r.left_tag, r["size"]) for r in step.patterns.collect())
            results.append((patterns, pairs_of(step.merged)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_histograms_add_up(two_rounds):
    step = two_rounds.rounds[0]
    joins = {r.bucket: r.n for r in step.join_histogram().collect()}
    assert joins == {9: 6}
    matches = {r.bucket: r.n for r in step.match_histogram().collect()}
    # Thirteen segments like the pattern, and two that share nothing with it.
    assert matches == {9: 13, 0: 2}
    tuples = {r.bucket: r.n for r in step.tuple_histogram().collect()}
    assert sum(tuples.values()) == 6


def test_best_location_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame(
        [("o", "b", 0.95, 1), ("o", "a", 0.95, 1), ("p", "z", 0.9, 1)], "org STRING, loc STRING, confidence DOUBLE, n BIGINT"
    )
    assert pairs_of(score.new_seeds(df)) == [("o", "a")]


def test_best_pattern_tie_goes_to_the_lowest_id(spark):
    df = spark.createDataFrame(
        [(1, 1, 7, 0.8), (1, 1, 3, 0.8), (1, 1, 1, 0.7)], "c1 BIGINT, c2 BIGINT, pattern_id INT, similarity DOUBLE"
    )
    row = score.best_pattern(df).first()
    assert (row.pattern_id, row.similarity) == (3, 0.8)


def test_level1_sizes_add_up_to_the_raw_patterns(rendered, known):
    raw = raw_patterns(mentions(rendered), known)
    for mode in ("exact", "two_level"):
        level1 = cluster_patterns(raw, Params(cluster_mode=mode))
        assert level1.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 491


def test_shuffle_joins_give_the_same_result(spark, rendered, known):
    """What is broadcast here is small; with large tables every join is a shuffle join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        step = Round(prepare_mentions(rendered), known)
        plan = step.candidates._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert step.counts()["candidates"] == 3009
        assert len(pairs_of(step.merged)) == 10
        plain = corpus.plain_sentences(spark, TINY)
        tagged = prepare.tag_entities(plain, corpus.gazetteer(spark, TINY))
        without_persons = F.regexp_replace("sentence", "</?PERSON>", "")
        assert tagged.exceptAll(rendered.withColumn("sentence", without_persons)).count() == 0
        assert tagged.count() == 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def shuffled_bytes(spark):
    """Bytes that all stages so far have written for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_later_round_equals_one_from_scratch(spark, rendered, known):
    """What a round takes from the last one is what it would find itself, also where pairs stood twice."""
    corpus_ = prepare_mentions(rendered)
    params = Params(cluster_mode="exact")
    first = Round(corpus_, known.union(known.limit(1)), params)
    after = first.merged
    delta, scratch = Round(corpus_, after, params, first), Round(corpus_, after, params)
    assert delta.counts() == scratch.counts()
    for table in ("raw", "labels", "patterns", "tuples", "merged"):
        a, b = (sorted(map(str, getattr(r, table).select(sorted(getattr(scratch, table).columns)).collect())) for r in (delta, scratch))
        assert a == b
    a, b = ({(r.c1, r.c2, r.pattern_id): round(r.similarity, 9) for r in x.matches.collect()} for x in (delta, scratch))
    assert a == b


def test_a_later_round_shuffles_only_what_is_new(spark, rendered):
    """Nine of ten organizations are known; the second round adds the tenth."""
    corpus_ = prepare_mentions(rendered)
    truth = corpus.supplier_nations(spark, TINY).select("org", "loc").orderBy("org")
    params = Params(cluster_mode="exact")
    marks = [shuffled_bytes(spark)]
    first = Round(corpus_, truth.where(F.col("org") != truth.first().org), params)
    for step in (lambda: first.raw, lambda: first.labels, lambda: first.matches):
        step()
    marks.append(shuffled_bytes(spark))
    second = Round(corpus_, first.merged, params, first)
    marks.append(shuffled_bytes(spark))
    for step in (lambda: second.raw, lambda: second.labels, lambda: second.matches):
        step()
    marks.append(shuffled_bytes(spark))
    print("shuffled", marks)
    assert 3 * (marks[3] - marks[2]) < marks[1] - marks[0]


def test_counts_take_no_job_of_their_own(spark, sentences, seeds):
    step = Round(prepare_mentions(sentences(*TEXTS)), seeds(*SEEDS))
    _ = step.merged
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert step.counts()["candidates"] == 13
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_tuple_confidence_has_the_same_bits_in_any_order(spark):
    rng = random.Random(3)
    rows = [(f"o{i % 5}", "l", rng.random(), rng.random(), rng.randrange(1, 4)) for i in range(3000)]
    rows += [("sure", "l", 1.0, 1.0, 2), ("sure", "l", 0.5, 0.5, 1), ("none", "l", 0.0, 0.7, 9), ("often", "l", 1e-9, 1.0, 10**12)]
    found = []
    for partitions in (1, 7, 200):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "org STRING, loc STRING, pattern_confidence DOUBLE, similarity DOUBLE, n BIGINT").repartition(partitions)
        found.append({r.org: (r.confidence.hex(), r.n) for r in score.tuple_confidence(df).collect()})
    assert found[0] == found[1] == found[2]
    misses = math.prod((1 - c * s) ** n for o, _, c, s, n in rows if o == "o1")
    assert float.fromhex(found[0]["o1"][0]) == pytest.approx(1 - misses, abs=1e-9)
    assert [float.fromhex(found[0][o][0]) for o in ("sure", "none")] == [1.0, 0.0]
    assert float.fromhex(found[0]["often"][0]) == pytest.approx(1.0)
