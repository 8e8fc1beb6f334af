"""From tagged sentences to weighted contexts around entity pairs.

``sentences`` is ``(sentence_id, sentence)`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.tagged import bare_tokens_sql, bind, entity_names, exploded, marked_sites_sql, marked_tokens_sql, sites_sql, tagged_tokens
from pairloom.functions.vectors import context_vector
from pairloom.operators import cutting
from pairloom.operators.cutting import WINDOW_COLUMNS, cut_sentences
from pairloom.operators.hot import spread_join
from pairloom.params import Params

# The cutting travels with its tasks, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(cutting)

CONTEXT_KEY = ["c1", "c2"]
WINDOWS = ["left_tag", "lw", "mw", "rw"]


def filter_by_tags(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """Sentences that contain both tag names as plain substrings."""
    first, second = params.entity_tags
    # Exploding a list of one keeps the filter above the text: below, a sentence that is rendered would be rendered for every test.
    once = sentences.withColumn("sentence", F.explode_outer(F.array("sentence")))
    return once.where(F.contains("sentence", F.lit(first)) & F.contains("sentence", F.lit(second)))


def org_sentences(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """``(sentence_id, org, sentence)``, one row per occurrence of an organization."""
    names = entity_names("sentence", params.entity_tags[0])
    return exploded(sentences, ["sentence_id", "sentence"], names, "org").select("sentence_id", "org", "sentence")


def sentence_seed_join(organizations: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(org, sentence_id, sentence, loc)``: occurrences of the seeds' organizations."""
    return organizations.join(seeds, "org").select("org", "sentence_id", "sentence", "loc")


def tokenize(sentences: DataFrame) -> DataFrame:
    """``(sentence_id, tokens)``."""
    return sentences.select("sentence_id", tagged_tokens("sentence").alias("tokens"))


def mention_sites(tokens: DataFrame, params: Params = Params()) -> DataFrame:
    """``(sentence_id, org_sites, loc_sites)``: 0-based token positions per tag."""
    first, second = params.entity_tags
    return tokens.select(
        "sentence_id",
        F.expr(sites_sql("tokens", first)).alias("org_sites"),
        F.expr(sites_sql("tokens", second)).alias("loc_sites"),
    )


def _pairs(params: Params, text: str, windows: bool) -> str:
    """SQL of the site pairs of ``s`` within reach of each other, optionally with their token windows; ``text`` are the tokens' texts."""
    first, second = params.entity_tags
    width = params.window_size
    fields = (
        f"'a', a, 'b', b, 'org', get({text}, a), 'loc', get({text}, b), "
        f"'left_tag', if(a < b, '{first}', '{second}')"
    )
    if windows:
        fields += (
            f", 'lw', slice({text}, greatest(least(a, b) - {width}, 0) + 1, least({width}, a, b))"
            f", 'mw', slice({text}, least(a, b) + 2, abs(a - b) - 1)"
            f", 'rw', slice({text}, greatest(a, b) + 2, {width})"
        )
    return (
        "flatten(transform(s.orgs, a -> transform("
        f"filter(s.locs, b -> abs(a - b) <= {params.max_distance}), b -> named_struct({fields}))))"
    )


def entity_pairs(tokens: DataFrame, params: Params = Params()) -> DataFrame:
    """``(sentence_id, a, b, org, loc, left_tag)``: a band join inside each sentence, without a shuffle."""
    first, second = params.entity_tags
    both = f"named_struct('orgs', {sites_sql('t', first)}, 'locs', {sites_sql('t', second)})"
    # The token list and the sites are each bound once: inlined at every use they would be computed anew for every element.
    pairs = bind("tokens", "t", bind(both, "s", _pairs(params, "t.text", windows=False)))
    return exploded(tokens, ["sentence_id"], F.expr(pairs), "pair").select("sentence_id", "pair.*")


def context_windows(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """Entity pairs with the tokens left of, between and right of the two mentions.

    ``occurrences`` counts the organization in :func:`org_sentences`' reading of
    the sentence, which is how often the pair counts as a raw pattern. One
    pass over each row: no UDF and no shuffle.
    """
    first, second = params.entity_tags
    both = f"named_struct('orgs', {marked_sites_sql('t', first)}, 'locs', {marked_sites_sql('t', second)})"
    cut = bind(bare_tokens_sql("t"), "w", _pairs(params, "w", windows=True))
    pairs = bind(marked_tokens_sql("sentence"), "t", bind(both, "s", f"if(size(s.orgs) > 0 AND size(s.locs) > 0, {cut}, null)"))
    names = entity_names("sentence", first).alias("names")
    return exploded(sentences, ["sentence_id", names], F.expr(pairs), "pair").select(
        "sentence_id",
        "pair.*",
        F.size(F.filter("names", lambda n: n == F.col("pair.org"))).cast("bigint").alias("occurrences"),
    )


def sorted_windows(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """``(org, loc, left_tag, windows, occurrences)`` of :func:`context_windows`, a batch of sentences at a time; see :func:`window_lists`."""
    tags, width, reach = params.entity_tags, params.window_size, params.max_distance

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(cut_sentences(batch.column(0), tags, width, reach), WINDOW_COLUMNS)

    return sentences.select("sentence").mapInArrow(cut, "org STRING, loc STRING, left_tag STRING, windows STRING, occurrences BIGINT")


def window_lists(joined: DataFrame) -> DataFrame:
    """Replace ``windows`` by the sorted lists ``lw, mw, rw``."""
    kept = [c for c in joined.columns if c != "windows"]
    listed = lambda i: F.expr(f"if(get(parts, {i}) = '', CAST(array() AS ARRAY<STRING>), split(get(parts, {i}), '\u0001'))")
    cut = joined.select(*kept, F.split("windows", "\u0002").alias("parts"))
    return cut.select(*kept, *(listed(i).alias(w) for i, w in enumerate(("lw", "mw", "rw"))))


def with_vectors(windows: DataFrame) -> DataFrame:
    """Replace the token windows ``lw, mw, rw`` by context vectors ``lc, mc, rc``."""
    kept = [c for c in windows.columns if c not in ("lw", "mw", "rw")]
    vectors = [context_vector(w).alias(v) for w, v in (("lw", "lc"), ("mw", "mc"), ("rw", "rc"))]
    return windows.select(*kept, *vectors)


def text_segments(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """``(sentence_id, a, b, org, loc, left_tag, occurrences, lc, mc, rc)`` for every entity pair."""
    return with_vectors(context_windows(sentences, params))


def mentions(sentences: DataFrame, params: Params = Params()) -> DataFrame:
    """Text segments with equal ones counted: ``(org, loc, left_tag, lw, mw, rw, n, weight, c1, c2)``.

    ``n`` is the number of segments and ``weight`` the sum of their occurrences.
    Order inside a window does not matter to any score, so windows are sorted
    and copies fold together on the map side, before the only shuffle. The
    128-bit key ``c1, c2`` names the context; sizes enter it so that no two
    splits of the same tokens share a key.
    """
    windows = sorted_windows(filter_by_tags(sentences, params), params)
    counted = windows.groupBy("org", "loc", "left_tag", "windows").agg(
        F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("weight")
    )
    counted = window_lists(counted).select("org", "loc", *WINDOWS, "n", "weight")
    identity = ["left_tag", F.size("lw"), "lw", F.size("mw"), "mw", F.size("rw"), "rw"]
    return counted.withColumns(
        {"c1": F.xxhash64(*identity), "c2": F.xxhash64(F.lit("context"), *identity)}
    )


def distinct_contexts(mentioned: DataFrame) -> DataFrame:
    """``(c1, c2, left_tag, lc, mc, rc)``, one row per distinct context of :func:`mentions`."""
    return with_vectors(mentioned.select(*CONTEXT_KEY, *WINDOWS).distinct())


def seed_counts(seeds: DataFrame) -> DataFrame:
    """Seeds as ``(org, loc, copies)``: duplicate seeds multiply the joins they take part in. Counted ones stay as they are."""
    if "copies" in seeds.columns:
        return seeds
    return seeds.groupBy("org", "loc").agg(F.count(F.lit(1)).alias("copies"))


def seed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(org, loc, copies)``: how many more times a pair is in ``after``; pairs that are as often in both are left out."""
    taken = seed_counts(before).withColumn("copies", -F.col("copies"))
    both = seed_counts(after).unionByName(taken).groupBy("org", "loc").agg(F.sum("copies").alias("copies"))
    return both.where(F.col("copies") != 0)


def added_patterns(before: DataFrame, change: DataFrame) -> DataFrame:
    """Raw patterns with those of changed seeds added."""
    both = before.unionByName(change).groupBy("left_tag", "lc", "mc", "rc").agg(F.sum("weight").alias("weight"))
    return both.where(F.col("weight") > 0)


def raw_patterns(mentioned: DataFrame, seeds: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``(left_tag, lc, mc, rc, weight)``: contexts of the seed pairs, one row per distinct context.

    ``weight`` is the number of raw patterns with that context. Seeds may come
    counted, also with the negative counts of :func:`seed_changes`; weights then
    add up to those of the seeds after the changes. ``hot`` lists frequent
    organizations, whose rows the join deals to several tasks.
    """
    present = mentioned.where(F.col("weight") > 0).select("org", "loc", *WINDOWS, "weight")
    found = (
        spread_join(present, seed_counts(seeds), ["org", "loc"], hot, "org")
        .groupBy(*WINDOWS)
        .agg(F.sum(F.col("weight") * F.col("copies")).alias("weight"))
    )
    # Different windows can share a vector (a b a b and a b), so vectors are counted again.
    return with_vectors(found).groupBy("left_tag", "lc", "mc", "rc").agg(F.sum("weight").alias("weight"))
