"""Pattern confidence, tuple confidence and new seeds.

``mentioned`` is the counted segment table of :func:`pairloom.operators.segments.mentions`,
``matches`` is ``(c1, c2, pattern_id, similarity)``, or for supports and best patterns also folded; ``hot`` lists frequent organizations and contexts
(:func:`pairloom.operators.hot.hot_keys` over ``org`` and ``c1``), whose rows joins deal to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import bucket_of
from pairloom.operators.folded import FoldedMatches, best_candidates, folded_support
from pairloom.operators.hot import spread_join
from pairloom.operators.segments import CONTEXT_KEY, seed_counts
from pairloom.params import Params


def pattern_matches(mentioned: DataFrame, matches: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``(org, loc, c1, c2, n, pattern_id, similarity)`` of every matched segment, equal ones counted in ``n``."""
    return spread_join(mentioned.select("org", "loc", *CONTEXT_KEY, "n"), matches, CONTEXT_KEY, hot, "c1")


def match_seed_join(matched: DataFrame, seeds: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Matched segments of known organizations, once per known location ``seed_loc``."""
    known = seeds.select("org", F.col("loc").alias("seed_loc"))
    return spread_join(matched, known, ["org"], hot, "org")


def label_contexts(mentioned: DataFrame, seeds: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``(c1, c2, positives, negatives)``: segments of known organizations by whether their location is the known one.

    Every pattern that matches a context matches all its segments, so the labels
    are summed per context before any pattern is involved.
    """
    known = seed_counts(seeds).withColumnRenamed("loc", "seed_loc")
    correct = F.col("loc") == F.col("seed_loc")
    times = F.col("n") * F.col("copies")
    return (
        spread_join(mentioned.select("org", "loc", *CONTEXT_KEY, "n"), known, ["org"], hot, "org")
        .groupBy(*CONTEXT_KEY)
        .agg(
            F.sum(F.when(correct, times).otherwise(0)).alias("positives"),
            F.sum(F.when(correct, 0).otherwise(times)).alias("negatives"),
        )
    )


def added_labels(before: DataFrame, change: DataFrame) -> DataFrame:
    """Labels with those of changed seeds added."""
    sums = [F.sum(c).alias(c) for c in ("positives", "negatives")]
    return before.unionByName(change).groupBy(*CONTEXT_KEY).agg(*sums).where("positives + negatives > 0")


def pattern_support(matches: DataFrame | FoldedMatches, labels: DataFrame) -> DataFrame:
    """``(pattern_id, positives, negatives)``; patterns without a known organization drop out."""
    if isinstance(matches, FoldedMatches):
        return folded_support(matches, labels)
    return (
        matches.select(*CONTEXT_KEY, "pattern_id")
        .join(labels, CONTEXT_KEY)
        .groupBy("pattern_id")
        .agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    )


def pattern_confidence(support: DataFrame) -> DataFrame:
    """Add ``confidence``, the share of positives."""
    return support.withColumn("confidence", F.col("positives") / (F.col("positives") + F.col("negatives")))


def best_pattern(matches: DataFrame | FoldedMatches) -> DataFrame:
    """Per context the most similar pattern; a tie goes to the lowest id."""
    if isinstance(matches, FoldedMatches):
        matches = best_candidates(matches)
    best = F.max(F.struct("similarity", (-F.col("pattern_id")).alias("minus_id"))).alias("best")
    return matches.groupBy(*CONTEXT_KEY).agg(best).select(
        *CONTEXT_KEY, (-F.col("best.minus_id")).alias("pattern_id"), "best.similarity"
    )


def candidate_tuples(mentioned: DataFrame, best: DataFrame, confidence: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``(org, loc, pattern_confidence, similarity, n)``: segments whose best pattern has a confidence."""
    scored = best.join(confidence.select("pattern_id", F.col("confidence").alias("pattern_confidence")), "pattern_id")
    found = spread_join(mentioned.select("org", "loc", *CONTEXT_KEY, "n"), scored, CONTEXT_KEY, hot, "c1")
    return found.select("org", "loc", "pattern_confidence", "similarity", "n")


# Logarithms are added as whole numbers of this unit, so that their order does not matter.
_LOG_UNIT = 1 << 40


def tuple_confidence(candidates: DataFrame) -> DataFrame:
    """``(org, loc, confidence, n)``: one minus the product of the misses of all ``n`` occurrences.

    The product is a sum of logarithms in fixed point: the same bits whatever
    the partitions and the order of rows. An occurrence without a miss makes
    the confidence 1.
    """
    miss = F.lit(1.0) - F.col("pattern_confidence") * F.col("similarity")
    units = F.round(F.ln(F.when(miss > 0, miss)) * _LOG_UNIT).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    total = F.sum(F.coalesce(units, F.lit(0).cast("decimal(37,0)")))
    product = F.when(F.max(miss <= 0), 0.0).otherwise(F.exp(total.cast("double") / _LOG_UNIT))
    return candidates.groupBy("org", "loc").agg((F.lit(1.0) - product).alias("confidence"), F.sum("n").alias("n"))


def filtered_tuples(confidences: DataFrame, params: Params = Params()) -> DataFrame:
    """Tuples strictly above the confidence threshold."""
    return confidences.where(F.col("confidence") > params.tuple_confidence_threshold)


def new_seeds(confidences: DataFrame, params: Params = Params()) -> DataFrame:
    """``(org, loc)``: each organization's most confident location; a tie goes to the first in order."""
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), "loc")).alias("best")
    return filtered_tuples(confidences, params).groupBy("org").agg(best).select("org", "best.loc")


def merge_seeds(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Known and new pairs, each once; a known pair is never withdrawn."""
    return seeds.select("org", "loc").union(found.select("org", "loc")).distinct()


def histogram(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """``(bucket, n)``: rows, or their ``weight``, per tenth of ``column``."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(bucket_of(column).alias("bucket")).agg(size.alias("n"))


def join_histogram(level1: DataFrame) -> DataFrame:
    """``(bucket, n)``: best similarity of every raw pattern that was compared in level 1."""
    counted = level1.select(F.posexplode("histogram").alias("bucket", "n"))
    return counted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def match_histogram(mentioned: DataFrame, counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(bucket, n)`` over every segment and pattern.

    ``counts`` is ``(bucket, n)`` of all pairs above bucket 0; every other pair
    is in bucket 0, which is the number of all pairs less the others.
    """
    zero = F.lit(0).cast("bigint")
    all_segments = mentioned.agg(F.sum("n").alias("segments")).select("segments", zero.alias("patterns"), zero.alias("found"))
    count = patterns.agg(F.count(F.lit(1)).alias("patterns")).select(zero.alias("segments"), "patterns", zero.alias("found"))
    found = counts.agg(F.sum("n").alias("found")).select(zero.alias("segments"), zero.alias("patterns"), "found")
    totals = all_segments.union(count).union(found).agg(F.sum("segments"), F.sum("patterns"), F.sum("found")).toDF("s", "p", "f")
    rest = totals.select(
        F.lit(0).alias("bucket"),
        (F.coalesce("s", zero) * F.coalesce("p", zero) - F.coalesce("f", zero)).alias("n"),
    )
    return counts.unionByName(rest).where(F.col("n") > 0)
