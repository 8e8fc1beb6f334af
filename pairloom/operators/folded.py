"""Matches without a row for each: classes of contexts against classes of patterns.

Where patterns are contexts themselves (exact clustering), contexts that differ by a name only all match one another, which is quadratic in
the names. A name is a rare token: few contexts and few patterns hold it. Contexts with equal tokens but for rare ones, and equal lengths,
form a class; so do patterns. A context and a pattern without a rare token in common are exactly as similar as their classes, so that
classes are matched instead. Pairs with a rare token in common, few by the meaning of rare, are scored one by one and stand beside, matching
or not. Nothing is left out and no similarity is rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import PARTS
from pairloom.operators.cluster import _ranked
from pairloom.operators.match import OWN, match_contexts, pattern_index, score_pairs, with_norms
from pairloom.operators.segments import CONTEXT_KEY
from pairloom.params import Params
from pairloom.staging import stage

_GROUP = ["left_tag", "signature"]
_TOKEN = [*_GROUP, "part", "token"]

#: A token is rare if at most so many contexts and at most so many patterns hold it.
RARE = 32


@dataclass(frozen=True)
class FoldedMatches:
    """What matches: every context and pattern whose classes do, but for the ``singles``, which say so themselves.

    ``members`` is ``(c1, c2, a)``, the class of every context that has patterns like it. ``patterns`` is ``(pattern_id, b, slot)``: class, and
    place in it by id. ``pairs`` is ``(a, b, class_similarity, place, lowest)`` of the classes that match: the place of ``b`` among those of ``a``,
    the most similar first, then by ``lowest``, the lowest id in ``b``. ``singles`` is ``(c1, c2, pattern_id, similarity, a, b, slot,
    class_similarity, place)`` of pairs with a rare token in common; ``similarity`` is NULL where they do not match, ``class_similarity``
    where their classes do not.
    """

    members: DataFrame
    patterns: DataFrame
    pairs: DataFrame
    singles: DataFrame


def _tokens(df: DataFrame, kept: list[str]) -> DataFrame:
    """One row per token, with group and lengths; a row without tokens keeps one."""
    listed = ", ".join(f"transform({p}, x -> named_struct('part', '{p}', 'token', x.token, 'weight', x.weight))" for p in PARTS)
    columns = [*kept, *_GROUP, *OWN]
    return df.select(*columns, F.explode_outer(F.expr(f"concat({listed})")).alias("x")).select(*columns, "x.*")


def _classed(df: DataFrame, kept: list[str], held: DataFrame, name: str, out: str) -> DataFrame:
    """``kept``, the class ``name`` as a 128-bit key, and what its members have in common."""
    part = lambda p: F.when((F.col("part") == p) & ~F.col("rare"), F.struct("token", "weight"))
    folded = (
        _tokens(df, kept)
        .join(held, _TOKEN, "left")
        .groupBy(*kept)
        .agg(*(F.first(c).alias(c) for c in (*_GROUP, *OWN)), *(F.sort_array(F.collect_list(part(p))).alias(p) for p in PARTS))
    )
    identity = [*_GROUP, *OWN, *(x for p in PARTS for x in (F.size(p), p))]
    key = F.struct(F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit("class"), *identity).alias("k2"))
    return stage(folded.select(*kept, key.alias(name), *_GROUP, *OWN, *PARTS), out)


def _classes(members: DataFrame, name: str) -> DataFrame:
    return members.groupBy(name).agg(*(F.first(c).alias(c) for c in (*_GROUP, *OWN, *PARTS)))


def _placed(rows: DataFrame, within: str, order: list[str | Column], place: str, name: str) -> DataFrame:
    """Add ``place``, from 0 in the given order inside each ``within``: ranks of all rows less the first one's, so no group is gathered."""
    ranks = stage(_ranked(rows, [within, *order], f"{name}-ranks"), name)
    first = ranks.groupBy(within).agg(F.min("rank").alias("first"))
    return ranks.join(first, within).select(*rows.columns, (F.col("rank") - F.col("first")).alias(place))


def fold_matches(contexts: DataFrame, patterns: DataFrame, threshold: float, params: Params = Params()) -> FoldedMatches:
    """The matches of :func:`match_contexts` over ``contexts`` ``(c1, c2, ...)`` and ``patterns`` ``(pattern_id, ...)``, both staged."""
    known = with_norms(patterns)
    groups = known.select(*_GROUP).distinct()
    alike = with_norms(contexts).join(F.broadcast(groups), _GROUP, "left_semi")
    held = _tokens(alike, CONTEXT_KEY).groupBy(*_TOKEN).agg(F.count(F.lit(1)).alias("n"))
    held = held.join(_tokens(known, ["pattern_id"]).groupBy(*_TOKEN).agg(F.count(F.lit(1)).alias("n_patterns")), _TOKEN)
    held = stage(held.select(*_TOKEN, (F.greatest("n", "n_patterns") <= RARE).alias("rare")), "held")

    of_contexts = _classed(alike, CONTEXT_KEY, held, "a", "context-classes")
    of_patterns = _classed(known, ["pattern_id"], held, "b", "pattern-classes")
    classes = stage(_classes(of_patterns, "b"), "classes")
    index = stage(pattern_index(classes, threshold, params, key="b"), "class-index")
    met = match_contexts(stage(_classes(of_contexts, "a"), "classes"), classes, index, threshold, params, key="b")
    met = met.withColumnRenamed("similarity", "class_similarity")

    slots = stage(_placed(of_patterns.select("pattern_id", "b"), "b", ["pattern_id"], "slot", "slots"), "patterns")
    lowest = slots.where("slot = 0").select("b", F.col("pattern_id").alias("lowest"))
    met = stage(met, "met").join(lowest, "b").select("a", "b", "class_similarity", "lowest")
    pairs = stage(_placed(met, "a", [F.desc("class_similarity"), "lowest"], "place", "places"), "pairs")

    rare = held.where("rare").drop("rare")
    holding = lambda df, kept: _tokens(df, kept).join(rare, _TOKEN).select(*kept, *_TOKEN)
    touching = holding(alike, CONTEXT_KEY).join(holding(known, ["pattern_id"]), _TOKEN).select(*CONTEXT_KEY, "pattern_id").distinct()
    scored = score_pairs(stage(touching, "touching"), contexts, patterns, threshold, params)
    scored = scored.withColumn("similarity", F.when(F.col("similarity") >= threshold, F.col("similarity")))
    members = of_contexts.select(*CONTEXT_KEY, "a")
    singles = scored.join(members, CONTEXT_KEY).join(slots, "pattern_id").join(pairs.drop("lowest"), ["a", "b"], "left")
    columns = [*CONTEXT_KEY, "pattern_id", "similarity", "a", "b", "slot", "class_similarity", "place"]
    return FoldedMatches(members, slots, pairs, stage(singles.select(*columns), "singles"))


def _first_free(places: str) -> Column:
    """The lowest number from 0 that is not among the collected ones."""
    wrong = f"filter(transform(sort_array(collect_set({places})), (x, i) -> if(x = i, null, i)), i -> i IS NOT NULL)"
    return F.expr(f"CAST(coalesce(get({wrong}, 0), size(collect_set({places}))) AS BIGINT)")


def folded_support(matches: FoldedMatches, labels: DataFrame) -> DataFrame:
    """``(pattern_id, positives, negatives)``: what the classes of contexts add up to, corrected by the single pairs."""
    names = ["positives", "negatives", "labelled"]
    sums = [F.sum(c).alias(c) for c in names]
    labelled = labels.withColumn("labelled", F.lit(1).cast("bigint"))
    of_classes = labelled.join(matches.members, CONTEXT_KEY).groupBy("a").agg(*sums)
    whole = matches.pairs.join(of_classes, "a").groupBy("b").agg(*sums).join(matches.patterns, "b").select("pattern_id", *names)
    change = F.col("similarity").isNotNull().cast("int") - F.col("class_similarity").isNotNull().cast("int")
    single = matches.singles.withColumn("change", change).where("change <> 0").join(labelled, CONTEXT_KEY)
    both = whole.unionByName(single.select("pattern_id", *((F.col(c) * F.col("change")).alias(c) for c in names)))
    return both.groupBy("pattern_id").agg(*sums).where("labelled > 0").drop("labelled")


def best_candidates(matches: FoldedMatches) -> DataFrame:
    """``(c1, c2, pattern_id, similarity)``: matches of every context, its best one among them.

    These are its single pairs; of a class that holds some of them, the lowest of the others; and of the classes that hold
    none, the first pattern of the first one.
    """
    columns = [*CONTEXT_KEY, "pattern_id", "similarity"]
    touched = matches.singles.where("place IS NOT NULL")
    beside = touched.groupBy(*CONTEXT_KEY, "b").agg(_first_free("slot").alias("slot"), F.first("class_similarity").alias("similarity"))
    beside = beside.join(matches.patterns, ["b", "slot"]).select(*columns)
    free = touched.groupBy(*CONTEXT_KEY).agg(_first_free("place").alias("place"))
    whole = matches.members.join(free, CONTEXT_KEY, "left").withColumn("place", F.coalesce("place", F.lit(0).cast("bigint")))
    whole = whole.join(matches.pairs, ["a", "place"]).select(*CONTEXT_KEY, F.col("lowest").alias("pattern_id"), F.col("class_similarity").alias("similarity"))
    return matches.singles.where("similarity IS NOT NULL").select(*columns).unionByName(beside).unionByName(whole)
