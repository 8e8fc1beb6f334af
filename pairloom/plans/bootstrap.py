"""The bootstrap loop: seeds find patterns, patterns find tuples, tuples become seeds."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import PARTS
from pairloom.operators.cluster import cluster_patterns, final_patterns
from pairloom.operators.folded import FoldedMatches, fold_matches
from pairloom.operators.hot import hot_keys
from pairloom.operators.match import match_contexts, pattern_index, similarity_counts
from pairloom.operators.score import (
    added_labels,
    best_pattern,
    candidate_tuples,
    histogram,
    join_histogram,
    label_contexts,
    match_histogram,
    merge_seeds,
    new_seeds,
    pattern_confidence,
    pattern_support,
    tuple_confidence,
)
from pairloom.operators.segments import CONTEXT_KEY, added_patterns, distinct_contexts, mentions, raw_patterns, seed_changes
from pairloom.params import Params
from pairloom.staging import measured_stage, stage

METRICS = ["raw_patterns", "centroids", "final_patterns", "text_segments", "candidates", "new_seeds", "total_seeds"]
#: Exact rounds with more patterns than this match classes of contexts; with fewer, a context has no more matches than that.
FOLD_BEYOND = 128
METRICS_SCHEMA = "iteration INT, " + ", ".join(f"{m} BIGINT" for m in METRICS) + ", seconds DOUBLE"


@dataclass(frozen=True)
class Corpus:
    """What every round reads and none changes."""

    mentions: DataFrame
    contexts: DataFrame
    segments: int
    hot: DataFrame | None = None


def prepare_mentions(sentences: DataFrame, params: Params = Params()) -> Corpus:
    """Tokenize and cut contexts once: the counted segments, their distinct contexts, and frequent keys, all written."""
    mentioned, sums = measured_stage(mentions(sentences, params), "mentions", segments=F.col("n"))
    hot = stage(hot_keys(mentioned, "org", "c1"), "hot")
    return Corpus(mentioned, stage(distinct_contexts(mentioned), "contexts"), sums["segments"], hot)


class Round:
    """One round from one seed set. Each table is computed, and written, when first asked for.

    A round that follows ``last`` looks up only the pairs that were added (or
    counted several times before) and the patterns that are new; raw patterns,
    labels and matches of the others are taken from there. Stage counts are
    gathered while the tables are written.
    """

    def __init__(self, corpus: Corpus, seeds: DataFrame, params: Params = Params(), last: Round | None = None) -> None:
        self.corpus, self.seeds, self.params, self.last = corpus, seeds, params, last
        self._sums: dict[str, int] = {"text_segments": corpus.segments}

    def _measured(self, df: DataFrame, name: str, **totals: Column) -> DataFrame:
        written, sums = measured_stage(df, name, **totals)
        self._sums |= sums
        return written

    @cached_property
    def changes(self) -> DataFrame:
        """The seeds, or what is different from those of the last round."""
        return self.seeds if self.last is None else stage(seed_changes(self.last.seeds, self.seeds), "changes")

    @cached_property
    def raw(self) -> DataFrame:
        found = raw_patterns(self.corpus.mentions, self.changes, self.corpus.hot)
        found = found if self.last is None else added_patterns(self.last.raw, found)
        return self._measured(found, "raw", raw_patterns=F.col("weight"))

    @cached_property
    def labels(self) -> DataFrame:
        found = label_contexts(self.corpus.mentions, self.changes, self.corpus.hot)
        return stage(found if self.last is None else added_labels(self.last.labels, found), "labels")

    @cached_property
    def level1(self) -> DataFrame:
        return self._measured(cluster_patterns(self.raw, self.params), "level1", centroids=F.col("copies"))

    @cached_property
    def patterns(self) -> DataFrame:
        return self._measured(final_patterns(self.level1, self.params), "final", final_patterns=F.lit(1))

    @cached_property
    def matches(self) -> DataFrame:
        threshold = self.params.degree_of_match_threshold
        fresh, known = self.patterns, None
        if self.last is not None:
            content = ["left_tag", *PARTS]
            before = self.last.patterns.select(F.col("pattern_id").alias("old_id"), *content)
            same = stage(self.patterns.join(before, content).select("pattern_id", "old_id"), "same")
            known = self.last.matches.withColumnRenamed("pattern_id", "old_id").join(same, "old_id")
            fresh = stage(self.patterns.join(same, "pattern_id", "left_anti"), "fresh")
        index = stage(pattern_index(fresh, threshold, self.params), "index")
        found = match_contexts(self.corpus.contexts, fresh, index, threshold, self.params)
        return stage(found if known is None else found.unionByName(known.select(found.columns)), "matches")

    @cached_property
    def folded(self) -> DataFrame | FoldedMatches:
        """The matches, in exact mode without a row for each: there patterns are contexts, so alike ones grow with their product."""
        patterns = self.patterns
        if self.params.cluster_mode != "exact" or self._sums["final_patterns"] <= FOLD_BEYOND:
            return self.matches
        return fold_matches(self.corpus.contexts, patterns, self.params.degree_of_match_threshold, self.params)

    @cached_property
    def support(self) -> DataFrame:
        return pattern_support(self.folded, self.labels)

    @cached_property
    def confidence(self) -> DataFrame:
        return stage(pattern_confidence(self.support), "confidence")

    @cached_property
    def best(self) -> DataFrame:
        return best_pattern(self.folded)

    @cached_property
    def candidates(self) -> DataFrame:
        return candidate_tuples(self.corpus.mentions, self.best, self.confidence, self.corpus.hot)

    @cached_property
    def tuples(self) -> DataFrame:
        return self._measured(tuple_confidence(self.candidates), "tuples", candidates=F.col("n"))

    @cached_property
    def found(self) -> DataFrame:
        return self._measured(new_seeds(self.tuples, self.params), "found", new_seeds=F.lit(1))

    @cached_property
    def merged(self) -> DataFrame:
        return self._measured(merge_seeds(self.seeds, self.found), "seeds", total_seeds=F.lit(1))

    def join_histogram(self) -> DataFrame:
        return join_histogram(self.level1)

    def match_histogram(self) -> DataFrame:
        segments = self.corpus.mentions.groupBy(*CONTEXT_KEY).agg(F.sum("n").alias("n"))
        contexts = self.corpus.contexts.join(segments, CONTEXT_KEY)
        counts = stage(similarity_counts(contexts, self.patterns, self.params), "tenths")
        return match_histogram(self.corpus.mentions, counts, self.patterns)

    def tuple_histogram(self) -> DataFrame:
        return histogram(self.tuples, "confidence")

    def counts(self) -> dict[str, int]:
        """The stage counts, known once the last table of the round is written."""
        _ = self.merged
        return dict(self._sums)


@dataclass(frozen=True)
class Extraction:
    """The final seeds ``(org, loc)``, one metrics row per iteration, and the rounds behind them."""

    relations: DataFrame
    metrics: DataFrame
    rounds: tuple[Round, ...]


def bootstrap_relations(sentences: DataFrame, seeds: DataFrame, params: Params = Params()) -> Extraction:
    """Repeat rounds for ``params.iterations``, each starting from the last one's seeds.

    With ``early_stop`` the loop ends once a round that started from a set of
    pairs has added nothing: all later rounds would repeat it.
    """
    spark = sentences.sparkSession
    corpus = prepare_mentions(sentences, params)
    known = seeds.select("org", "loc")
    known = stage(known.distinct() if params.dedup_seeds else known, "seeds")
    rounds, rows = [], []
    # How many pairs the round starts from, if they are a set.
    before = None
    if params.early_stop and known.count() == known.distinct().count():
        before = known.count()
    for iteration in range(1, params.iterations + 1):
        started = time.monotonic()
        step = Round(corpus, known, params, rounds[-1] if rounds else None)
        counted = step.counts()
        rounds.append(step)
        rows.append((iteration, *(counted[m] for m in METRICS), time.monotonic() - started))
        if params.early_stop and counted["total_seeds"] == before:
            break
        known, before = step.merged, counted["total_seeds"]
    relations = rounds[-1].merged if rounds else known
    return Extraction(relations, spark.createDataFrame(rows, METRICS_SCHEMA), tuple(rounds))
