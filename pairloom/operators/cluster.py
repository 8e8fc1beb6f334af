"""Raw patterns to final patterns: clustering in two levels.

A context can only join a cluster with the same entity order and the same
non-empty contexts (any other score is zero or undefined), so one pass over all
rows splits exactly into at most 2 x 8 independent passes. Level 1 cuts these
further into buckets, as many as the settings say, whatever the number of rows.
Level 2 merges alike clusters wherever they come from: a similarity join of all
centroids, repeated until none would join another.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.vectors import PARTS, VECTOR, scaled_vector, signature
from pairloom.operators import passes
from pairloom.operators.match import match_contexts, pattern_index
from pairloom.operators.passes import BUCKETS, ClusterPass, as_vectors, sort_key
from pairloom.params import Params
from pairloom.staging import stage

# The pass travels with its tasks, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(passes)

GROUP = ["left_tag", "signature"]
CENTROID_COLUMNS = ["bucket", "left_tag", "signature", *PARTS, "size", "copies", "histogram"]
_CENTROID_SCHEMA = (
    f"bucket BIGINT, left_tag STRING, signature INT, lc {VECTOR}, mc {VECTOR}, rc {VECTOR}, "
    "size BIGINT, copies BIGINT, histogram ARRAY<BIGINT>"
)


def _sums(members: DataFrame) -> DataFrame:
    """``(cluster_id, left_tag, lc, mc, rc)``: the key-wise sums of the members' parts."""
    parts = F.concat(
        *(F.expr(f"transform({p}, x -> named_struct('part', '{p}', 'token', x.token, 'weight', x.weight))") for p in PARTS)
    )
    # One pass over the members: the tag travels with the tokens, and a member without any keeps one row.
    sums = (
        members.select("cluster_id", "left_tag", F.explode_outer(parts).alias("x"))
        .groupBy("cluster_id", "x.part", "x.token")
        .agg(F.min("left_tag").alias("left_tag"), F.sum("x.weight").alias("weight"))
    )
    return sums.groupBy("cluster_id").agg(
        F.min("left_tag").alias("left_tag"),
        *(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("token", "weight")))).alias(p) for p in PARTS),
    )


def centroids(members: DataFrame) -> DataFrame:
    """``(cluster_id, left_tag, lc, mc, rc)`` of members with these columns.

    Each part is summed key-wise and divided by its total. Sums combine on the
    map side, so a large cluster is no large group.
    """
    return _sums(members).select("cluster_id", "left_tag", *(scaled_vector(p).alias(p) for p in PARTS))


def _ungrouped(distinct: DataFrame, params: Params, joinable: bool) -> DataFrame:
    """Centroids where each distinct context is a partition of its own.

    Copies fold into one cluster if an equal context may join it; otherwise each
    copy is a cluster of size one, kept as one row with a ``copies`` count.
    """
    one, weight = F.lit(1).cast("bigint"), F.col("weight")
    similarity = F.create_map(*(F.lit(x) for s in range(8) for x in (s, passes.bucket(params.self_similarity(s)))))
    later = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.when(b == similarity[F.col("signature")], weight - 1).otherwise(0).cast("bigint"),
    )
    return distinct.select(
        F.lit(0).cast("bigint").alias("bucket"),
        *GROUP,
        *PARTS,
        (weight if joinable else one).alias("size"),
        (one if joinable else weight).alias("copies"),
        later.alias("histogram"),
    )


def _with_buckets(distinct: DataFrame, params: Params) -> DataFrame:
    """Assign ``bucket`` by the tokens of the middle context, so that alike ones meet, and of the other two; never by the number of rows."""

    def dealt(buckets: int, *parts: str) -> Column:
        text = F.concat_ws("|", *(F.expr(f"array_join(transform({p}, x -> x.token), ' ')") for p in parts))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets

    return distinct.withColumn("bucket", dealt(params.buckets, "mc") * params.side_buckets + dealt(params.side_buckets, "lc", "rc"))


def _pass_over_bucket(params: Params):
    threshold, plain = params.similarity_threshold, params.plain_cosine

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left_tag, sig, bucket = key
        items = [
            (int(w), as_vectors((lc, mc, rc)))
            for lc, mc, rc, w in zip(rows["lc"], rows["mc"], rows["rc"], rows["weight"])
        ]
        items.sort(key=lambda item: (-item[0], sort_key(item[1])))
        single = ClusterPass(threshold, plain)
        for weight, vectors in items:
            single.add(vectors, copies=weight, count=True)
        out = [
            (bucket, left_tag, sig, *single.centroid(c), single.sizes[c], 1, single.histograms[c].tolist())
            for c in range(len(single.sums))
        ]
        return pd.DataFrame(out, columns=CENTROID_COLUMNS)

    return run


def cluster_patterns(patterns: DataFrame, params: Params = Params()) -> DataFrame:
    """Level 1: raw patterns ``(left_tag, lc, mc, rc, weight)`` to sized centroids.

    A row stands for ``copies`` centroids of ``size`` members each; ``histogram``
    counts the best similarity of the members that were compared, by tenths.
    """
    distinct = (
        patterns.groupBy("left_tag", *PARTS)
        .agg(F.sum("weight").alias("weight"))
        .withColumn("signature", signature())
    )
    joinable = F.col("signature").isin(params.joinable_signatures())
    alone = _ungrouped(distinct.where(~joinable), params, joinable=False)
    if params.cluster_mode == "exact":
        return alone.unionByName(_ungrouped(distinct.where(joinable), params, joinable=True))
    clustered = (
        _with_buckets(distinct.where(joinable), params)
        .groupBy(*GROUP, "bucket")
        .applyInPandas(_pass_over_bucket(params), _CENTROID_SCHEMA)
    )
    return clustered.unionByName(alone)


def _similar(contexts: DataFrame, clusters: DataFrame, params: Params) -> DataFrame:
    """``(a, b, similarity)`` of every context of the one table and cluster of the other above the clustering threshold."""
    threshold = params.similarity_threshold
    patterns = clusters.select(F.col("place").alias("b"), "left_tag", *PARTS)
    index = stage(pattern_index(patterns, threshold, params, key="b"), "centroid-index")
    items = contexts.select(F.col("place").alias("a"), "left_tag", *PARTS)
    return match_contexts(items, patterns, index, threshold, params, key="b", strict=True)


def _links(pairs: DataFrame) -> DataFrame:
    """``(earlier, later, similarity)`` of every cluster that would join an earlier one, each pair once."""
    found = pairs.where(F.col("a") > F.col("b"))
    return found.groupBy(F.col("b").alias("earlier"), F.col("a").alias("later")).agg(F.max("similarity").alias("similarity"))


def merge_centroids(level1: DataFrame, params: Params = Params()) -> DataFrame:
    """Level 2: ``(left_tag, signature, lc, mc, rc, size)`` of clusters none of which would join an earlier one.

    Clusters stand in the order of their size, then of their contexts. A round
    joins every cluster with the earlier ones it is alike (it scores above
    ``similarity_threshold`` against their centroids). Clusters without an earlier
    alike one stay; every other one whose earlier alike ones include some of these
    moves into the most similar of them (the earlier of equals). Sums of vectors
    add up, so all level-1 centroids of a cluster weigh the same, and only
    clusters that grew are looked up anew. Rounds end when nothing is alike. No group or bucket is gathered in a task. The result
    depends on the rows and the settings only. Equal rows all count; no rows
    give no clusters.
    """
    joinable = F.col("signature").isin(params.joinable_signatures())
    columns = [*GROUP, *PARTS, "size"]
    ranked = _ranked(level1.where(joinable).select(*columns), [F.desc("size"), "left_tag", *PARTS], "level1-ranks")
    # Where a cluster stands: larger ones first, then those of the lower first rank.
    place = F.struct((-F.col("size")).alias("minus"), F.col("rank").alias("id"))
    clusters = stage(ranked.select(place.alias("place"), *columns), "clusters")
    links = stage(_links(_similar(clusters, clusters, params)), "links")
    while links.first() is not None:
        waiting = links.select(F.col("later").alias("earlier")).distinct()
        best = F.min(F.struct((-F.col("similarity")).alias("minus"), "earlier")).alias("best")
        moves = links.join(waiting, "earlier", "left_anti").groupBy("later").agg(best)
        moves = stage(moves.select(F.col("later").alias("place"), F.col("best.earlier").alias("into")), "moves")
        goals = moves.select(F.col("into").alias("place")).distinct()
        members = clusters.join(moves, "place").unionByName(clusters.join(goals, "place", "left_semi").withColumn("into", F.col("place")))
        members = members.withColumn("cluster_id", F.col("into.id"))
        sizes = members.groupBy("cluster_id").agg(F.sum("size").alias("size"), F.min("signature").alias("signature"))
        grown = _sums(members).join(sizes, "cluster_id").withColumnRenamed("cluster_id", "rank")
        grown = stage(grown.select(place.alias("place"), *columns), "grown")
        touched = moves.select("place").unionByName(goals)
        clusters = stage(clusters.join(touched, "place", "left_anti").unionByName(grown), "clusters")
        still = links
        for end in ("earlier", "later"):
            still = still.join(touched.withColumnRenamed("place", end), end, "left_anti")
        anew = _similar(grown, clusters, params).unionByName(_similar(clusters, grown, params))
        links = stage(still.unionByName(_links(anew)), "links")
    merged = clusters.select(*GROUP, *(scaled_vector(p).alias(p) for p in PARTS), "size")
    # Centroids that cannot join anything stay as they are.
    return merged.unionByName(level1.where(~joinable).select(*columns))


def _ranked(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``rank``, dense from 0 in the given order.

    The rows are sorted in parallel and written, and each partition's numbers
    start where the last one's ended; only the per-partition row counts are
    brought together.
    """
    within = F.monotonically_increasing_id()
    placed = stage(
        rows.orderBy(*order).select(
            "*",
            F.shiftright(within, 33).cast("int").alias("slice"),
            within.bitwiseAND(F.lit((1 << 33) - 1)).alias("within"),
        ),
        name,
    )
    counts = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "slice").select((F.col("offset") + F.col("within")).alias("rank"), *rows.columns)


def numbered(patterns: DataFrame) -> DataFrame:
    """Add ``pattern_id``, dense from 0 in the order size descending, tag, contexts."""
    ranked = _ranked(patterns, [F.desc("size"), "left_tag", *PARTS], "patterns")
    return ranked.select(F.col("rank").cast("int").alias("pattern_id"), "left_tag", *PARTS, "size")


def final_patterns(level1: DataFrame, params: Params = Params()) -> DataFrame:
    """``(pattern_id, left_tag, lc, mc, rc, size)``: clusters with more than ``minimal_cluster_size`` members.

    In exact mode level 1 is final.
    """
    clusters = level1 if params.cluster_mode == "exact" else merge_centroids(level1, params)
    kept = clusters.where(F.col("size") > params.minimal_cluster_size)
    return numbered(kept.select("left_tag", *PARTS, "size"))
