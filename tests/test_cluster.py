from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import model
from pairloom import Params
from pairloom.functions.vectors import PARTS, VECTOR
from pairloom.operators import cluster, score
from pairloom.operators.passes import ClusterPass, sort_key
from pairloom.staging import stage

RAW_SCHEMA = "left_tag STRING, " + ", ".join(f"{p} {VECTOR}" for p in PARTS) + ", weight BIGINT"


def random_vector(rng, words, empty=0.15, most=4):
    if rng.random() < empty:
        return {}
    return model.vector([(rng.choice(words), "") for _ in range(rng.randint(1, most))])


def random_patterns(rng, count, words="abcdefgh", empty=0.15, heaviest=4):
    """Distinct patterns with weights."""
    found = {}
    for _ in range(count):
        tag = rng.choice(["ORGANIZATION", "LOCATION"])
        parts = tuple(tuple(sorted(random_vector(rng, words, empty).items())) for _ in PARTS)
        found[(tag, *parts)] = rng.randint(1, heaviest)
    return [((tag, *map(dict, parts)), weight) for (tag, *parts), weight in found.items()]


def as_frame(spark, patterns):
    rows = [(p[0], *(sorted(v.items()) for v in p[1:]), w) for p, w in patterns]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def shape(tag, parts, size):
    return (tag, *(tuple(sorted((t, round(w, 6)) for t, w in v)) for v in parts), size)


def frame_shapes(df):
    return Counter(
        shape(r.left_tag, [[(x["token"], x["weight"]) for x in r[p]] for p in PARTS], r["size"]) for r in df.collect()
    )


def model_shapes(clusters):
    return Counter(
        shape(c[0], [v.items() for v in c[1:]], size) for c, size in ((model.centroid(m), n) for m, n in clusters)
    )


def group_of(p):
    return (p[0], *(bool(v) for v in p[1:]))


def pass_order(patterns):
    return sorted(patterns, key=lambda x: (-x[1], sort_key([sorted(v.items()) for v in x[0][1:]])))


def expanded(patterns):
    return [(p, 1) for p, w in pass_order(patterns) for _ in range(w)]


@pytest.mark.parametrize("plain", [False, True])
def test_level1_equals_one_sequential_pass(spark, plain):
    """Also shows that the 16 groups are independent: the model runs one ungrouped pass."""
    patterns = random_patterns(random.Random(1), 150)
    expected = model_shapes(model.cluster(expanded(patterns), plain=plain))
    got = cluster.cluster_patterns(as_frame(spark, patterns), Params(plain_cosine=plain, buckets=1, side_buckets=1))
    rows = got.withColumn("size", F.explode(F.array_repeat("size", F.col("copies").cast("int"))))
    assert frame_shapes(rows) == expected


def test_join_histogram_equals_sequential_passes(spark):
    patterns = random_patterns(random.Random(2), 120, heaviest=9)
    groups = defaultdict(list)
    for p, w in patterns:
        groups[group_of(p)].append((p, w))
    expected: Counter = Counter()
    joinable = Params().joinable_signatures()
    for (_, left, middle, right), members in groups.items():
        if left * 4 + middle * 2 + right in joinable:
            model.cluster(expanded(members), histogram=expected)
        else:
            for member in members:
                model.cluster(expanded([member]), histogram=expected)
    level1 = cluster.cluster_patterns(as_frame(spark, patterns), Params(buckets=1, side_buckets=1))
    got = {r.bucket: r.n for r in score.join_histogram(level1).collect()}
    assert got == {b: n for b, n in expected.items() if n}


def test_copies_count_like_single_items():
    vectors = ([("a", 1.0)], [("b", 0.5), ("c", 0.5)], [("d", 1.0)])
    near = ([("a", 0.5), ("e", 0.5)], [("b", 1.0)], [("d", 0.5), ("f", 0.5)])
    one, many = ClusterPass(0.4), ClusterPass(0.4)
    for p in (one, many):
        p.add(near, count=True)
    for _ in range(50):
        one.add(vectors, count=True)
    many.add(vectors, copies=50, count=True)
    assert one.sizes == many.sizes == [51]
    assert one.histograms[0].tolist() == many.histograms[0].tolist()
    assert one.norms[:, 0] == pytest.approx(many.norms[:, 0])


def test_exact_mode_groups_equal_contexts_only(spark):
    patterns = random_patterns(random.Random(3), 80)
    rows = cluster.cluster_patterns(as_frame(spark, patterns), Params(cluster_mode="exact")).collect()
    assert len(rows) == len(patterns)
    assert sum(r["size"] * r.copies for r in rows) == sum(w for _, w in patterns)
    for r in rows:
        assert (r.copies == 1) if r.signature in Params().joinable_signatures() else (r["size"] == 1)


def test_level1_depends_on_rows_and_settings_only(spark):
    """Ten times more rows of another entity order, another row order and other partitions change no cluster."""
    rng = random.Random(4)
    patterns = [((t, l, {"in": 1.0} if rng.random() < 0.7 else m, r), w) for (t, l, m, r), w in random_patterns(rng, 200, empty=0)]
    own = [x for x in patterns if x[0][0] == "ORGANIZATION"]
    other = [(("LOCATION", *p[1:]), w) for p, w in random_patterns(rng, 10 * len(own), empty=0)]
    params = Params()

    def clusters(rows, partitions):
        found = cluster.cluster_patterns(as_frame(spark, rows).repartition(partitions), params).where("left_tag = 'ORGANIZATION'")
        return sorted(str(r) for r in found.drop("histogram").collect())

    alone = clusters(own, 1)
    rng.shuffle(own)
    assert clusters(own + other, 7) == alone
    assert cluster.cluster_patterns(as_frame(spark, patterns), params).agg(F.sum("size")).first()[0] == sum(w for _, w in patterns)


def level2_frame(spark, patterns):
    return stage(cluster.cluster_patterns(as_frame(spark, patterns), Params(cluster_mode="exact")), "level1")


def level2_items(patterns):
    joinable = Params().joinable_signatures()
    return [(p, w) for p, w in patterns if sum(b for b, v in zip((4, 2, 1), p[1:]) if v) in joinable]


def alike(rows):
    """Clusters that would join a larger one."""
    clusters = [((r.left_tag, *({x["token"]: x["weight"] for x in r[p]} for p in PARTS)), r["size"]) for r in rows]
    pairs = ((c, d) for c, n in clusters for d, m in clusters if n < m)
    return [(c, d) for c, d in pairs if (model.similarity(c, d) or 0.0) > Params().similarity_threshold]


def final_sizes(clusters):
    return sorted((n for _, n in clusters if n > Params().minimal_cluster_size), reverse=True)


@pytest.mark.parametrize("words", ["abcdefgh", [f"w{i}" for i in range(40)]])
def test_no_merged_cluster_would_join_a_larger_one(spark, words):
    patterns = random_patterns(random.Random(5), 200, words, heaviest=9)
    joinable = F.col("signature").isin(Params().joinable_signatures())
    got = cluster.merge_centroids(level2_frame(spark, patterns)).where(joinable).collect()
    assert sum(r["size"] for r in got) == sum(w for _, w in level2_items(patterns))
    assert len(got) > 1 and not alike(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_default_settings_find_what_a_sequential_pass_over_everything_finds(spark, seed):
    """On contexts of diverse words: both levels at their default settings, against two passes without buckets."""
    patterns = random_patterns(random.Random(seed), 400, [f"w{i}" for i in range(40)], empty=0.05, heaviest=5)
    first = [(model.centroid(m), n) for m, n in model.cluster(expanded(patterns))]
    expected = final_sizes(model.cluster(sorted(first, key=lambda c: -c[1])))
    level1 = stage(cluster.cluster_patterns(as_frame(spark, patterns)), "level1")
    got = sorted((r["size"] for r in cluster.final_patterns(level1).collect()), reverse=True)
    assert abs(len(got) - len(expected)) <= 0.1 * len(expected)
    assert abs(sum(got) - sum(expected)) <= 0.1 * sum(expected)


def test_merging_follows_the_best_leader(spark):
    """A later cluster moves into the most similar earlier one that stays; one whose alike ones all move waits for the next round."""
    a = ("ORGANIZATION", {"x": 1.0}, {"y": 1.0}, {})
    b = ("ORGANIZATION", {"x": 0.5, "u": 0.5}, {"y": 0.5, "v": 0.5}, {})
    c = ("ORGANIZATION", {"u": 1.0}, {"v": 1.0}, {})
    apart = ("ORGANIZATION", {"p": 1.0}, {"q": 1.0}, {})
    rows = cluster.merge_centroids(level2_frame(spark, [(a, 9), (b, 7), (c, 5), (apart, 3)])).collect()
    merged = model.centroid([a, b])
    assert model.similarity(b, a) > 0.4 and model.similarity(c, b) > 0.4 and model.similarity(c, a) == 0
    sizes = [21, 3] if model.similarity(c, merged) > 0.4 else [16, 5, 3]
    assert sorted((r["size"] for r in rows), reverse=True) == sizes


def test_level2_depends_on_rows_and_settings_only(spark):
    """Ten times more rows of another entity order, another row order and other partitions change no cluster."""
    rng = random.Random(8)
    own = [(("ORGANIZATION", *p[1:]), w) for p, w in random_patterns(rng, 80, empty=0.05, heaviest=9)]
    own = list({repr(p): (p, w) for p, w in own}.values())
    other = [(("LOCATION", *p[1:]), w) for p, w in random_patterns(rng, 800, empty=0.05)]

    def clusters(rows, partitions):
        level1 = level2_frame(spark, rows).repartition(partitions)
        return sorted(str(r) for r in cluster.merge_centroids(level1).where("left_tag = 'ORGANIZATION'").collect())

    alone = clusters(own, 1)
    rng.shuffle(own)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert clusters(own + other, 7) == alone
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merging_loses_no_member_and_takes_empty_tables(spark):
    patterns = random_patterns(random.Random(9), 200, heaviest=9)
    level1 = level2_frame(spark, patterns)
    total = level1.agg(F.sum("size")).first()[0]
    assert cluster.merge_centroids(level1).agg(F.sum("size")).first()[0] == total
    assert cluster.merge_centroids(level1.where("false")).count() == 0


def test_size_rule_is_strict_and_ids_are_dense(spark):
    a = ("ORGANIZATION", {"x": 1.0}, {"y": 1.0}, {"z": 1.0})
    b = ("ORGANIZATION", {"p": 1.0}, {"q": 1.0}, {"r": 1.0})
    level1 = stage(cluster.cluster_patterns(as_frame(spark, [(a, 6), (b, 5)])), "level1")
    final = cluster.final_patterns(level1).collect()
    assert [(r.pattern_id, r["size"]) for r in final] == [(0, 6)]
    many = random_patterns(random.Random(7), 100, empty=0)
    exact = Params(cluster_mode="exact", minimal_cluster_size=0)
    rows = cluster.final_patterns(stage(cluster.cluster_patterns(as_frame(spark, many), exact), "level1"), exact).collect()
    rows.sort(key=lambda r: r.pattern_id)
    assert [r.pattern_id for r in rows] == list(range(len(many)))
    assert [r["size"] for r in rows] == sorted((w for _, w in many), reverse=True)


def test_centroids(spark):
    rows = [
        ("k", "LOCATION", [("a", 1.0)], [("b", 0.5), ("c", 0.5)], []),
        ("k", "LOCATION", [("a", 0.5), ("d", 0.5)], [("b", 1.0)], []),
        ("only", "ORGANIZATION", [], [], []),
    ]
    schema = "cluster_id STRING, left_tag STRING, " + ", ".join(f"{p} {VECTOR}" for p in PARTS)
    got = {r.cluster_id: r for r in cluster.centroids(spark.createDataFrame(rows, schema)).collect()}
    assert [tuple(x) for x in got["k"].lc] == [("a", 0.75), ("d", 0.25)]
    assert [tuple(x) for x in got["k"].mc] == [("b", 0.75), ("c", 0.25)]
    assert got["k"].rc == got["only"].lc == got["only"].mc == got["only"].rc == []
    assert got["only"].left_tag == "ORGANIZATION"
