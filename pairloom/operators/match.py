"""Contexts against patterns: a similarity join over posting rows.

Contexts and patterns are cut into postings, one thin row per token with the token's share of its part's length. A pair can only reach
a threshold if it shares one of the tokens the pattern cannot do without, so only those are indexed, the telling ones first. Products
of the postings that meet are summed per pair; with a bound on what the tokens left out can add, most pairs are settled there. The
vectors are joined once for each pair that is left. Nothing is capped: leaving a token out of the index is allowed only where the tokens
left out could not reach the threshold together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.vectors import PARTS, SLACK, degree_of_match, lookup, signature, squared_norm
from pairloom.params import Params
from pairloom.staging import stage

_MEETING = ["left_tag", "signature", "feature"]
_GROUP = ["left_tag", "signature"]
#: Squared lengths of the parts of a context, in a table whose vectors may hold some of their tokens only.
OWN = tuple(f"own_{p}" for p in PARTS)

#: About as many contexts and patterns in a block of the product, and copies of a pattern block for tasks to share a group.
CONTEXT_BLOCK, PATTERN_BLOCK, SHARES = 1024, 256, 16
#: A pattern with more tokens than this in a part is matched by a join of its tokens, not by looking each up in a map.
WIDE = 64


def with_norms(df: DataFrame) -> DataFrame:
    """Add signature and squared lengths of the parts; a table that brings them, since its vectors lack tokens, stays as it is."""
    if OWN[0] in df.columns:
        return df
    return df.select("*", signature().alias("signature"), *(squared_norm(p).alias(o) for p, o in zip(PARTS, OWN)))


def _units(df: DataFrame, kept: list[str]) -> DataFrame:
    """One row per token: ``kept``, left_tag, signature, part, feature and ``unit``, the weight over the length of its part."""
    items = ", ".join(
        f"transform({p}, x -> named_struct('part', '{p}', 'feature', concat('{p[0]}:', x.token), 'unit', x.weight / sqrt({o})))"
        for p, o in zip(PARTS, OWN)
    )
    normed = with_norms(df).select(*kept, *_GROUP, *PARTS, *OWN)
    carried = [*kept, "left_tag", "signature"]
    listed = normed.select(*carried, F.explode_outer(F.expr(f"concat({items})")).alias("x"))
    return listed.select(*carried, "x.*").where(F.col("feature").isNotNull())


def pattern_index(patterns: DataFrame, threshold: float, params: Params = Params(), key: str = "pattern_id") -> DataFrame:
    """Postings ``(key, left_tag, signature, feature, share, rest_lc, rest_mc, rest_rc)`` of the tokens a match must share one of.

    Tokens are ranked by how many patterns hold them over how much they add to
    the score, so common and weightless tokens come first. A leading run is left
    out as long as a context sharing only that run stays below ``threshold``;
    what remains is a small set of telling tokens that any match must share.
    ``rest`` is the part's share that was left out. Rows and work are linear in
    the tokens of a pattern.
    """
    features = _units(patterns, [key]).withColumn("share", F.col("unit") * F.col("unit")).drop("unit")
    commonness = features.groupBy(*_MEETING).agg(F.count(F.lit(1)).alias("patterns"))
    ranked = features.join(commonness, _MEETING)

    # Best score of a context that shares only the features up to and including this one.
    order = Window.partitionBy(key).orderBy(F.desc(F.col("patterns") / F.col("share")), "feature")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def reach(part: str) -> Column:
        return F.sum(F.when(F.col("part") == part, F.col("share")).otherwise(0.0)).over(upto)

    right_reach = reach("rc") if params.plain_cosine else reach("rc") / (1 + reach("rc"))
    best = (F.sqrt(reach("lc")) + F.sqrt(reach("mc")) + F.sqrt(right_reach)) / 3
    needed = F.col("best") >= threshold - SLACK
    whole = Window.partitionBy(key)
    rests = [F.sum(F.when((F.col("part") == p) & ~needed, F.col("share")).otherwise(0.0)).over(whole).alias(f"rest_{p}") for p in PARTS]
    marked = ranked.withColumn("best", best).select(key, *_MEETING, "share", "best", *rests)
    return marked.where(needed).drop("best")


def _candidates(contexts: DataFrame, index: DataFrame, threshold: float, params: Params, kept: list[str], key: str) -> DataFrame:
    """Pairs ``(kept, key)`` whose shared postings, with the best that the unindexed tokens could add, reach the threshold."""
    met = _units(contexts, kept).join(index, _MEETING)

    def summed(part: str, value: Column) -> Column:
        return F.sum(F.when(F.col("part") == part, value).otherwise(0.0))

    own, share = F.col("unit"), F.col("share")
    sums = [summed(p, own * F.sqrt(share)).alias(f"dot_{p}") for p in PARTS] + [summed(p, own * own).alias(f"seen_{p}") for p in PARTS]
    rests = [F.max(f"rest_{p}").alias(f"rest_{p}") for p in PARTS]
    pairs = met.groupBy(*kept, key).agg(*sums, *rests, summed("rc", share).alias("shared"))

    def bound(part: str) -> Column:
        return F.col(f"dot_{part}") + F.sqrt(F.greatest(F.lit(0.0), 1 - F.col(f"seen_{part}")) * F.col(f"rest_{part}"))

    right = bound("rc")
    if not params.plain_cosine:
        most = F.col("shared") + F.col("rest_rc")
        right = F.least(right / F.sqrt(1 + F.col("shared")), F.sqrt(most / (1 + most)))
    return pairs.where((bound("lc") + bound("mc") + right) / 3 >= threshold - SLACK).select(*kept, key)


def shared_weights(contexts: DataFrame, kept: list[str], patterns: DataFrame, on: list[str], key: str) -> DataFrame:
    """``(kept, key, lc_map, mc_map, rc_map)``: for each context and pattern that agree in ``on`` the pattern's weights of the tokens both hold.

    A join of token rows, so work grows with the tokens that meet, whatever the
    vocabulary of a pattern. Pairs that share no token are left out. ``kept``
    names a context, ``on`` is a part of it or of ``key``.
    """

    def tokens(df: DataFrame, columns: list[str], *fields: str) -> DataFrame:
        taken = "".join(f", '{f}', x.{f}" for f in fields)
        listed = F.expr("concat(" + ", ".join(f"transform({p}, x -> named_struct('part', '{p}'{taken}))" for p in PARTS) + ")")
        return df.select(*columns, F.explode_outer(listed).alias("x")).select(*columns, "x.*").where(F.col("part").isNotNull())

    left = tokens(contexts, list(dict.fromkeys([*kept, *on])), "token")
    right = tokens(patterns, list(dict.fromkeys([*on, key])), "token", "weight")
    shared = left.join(right, [*on, "part", "token"])
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("part") == p, F.struct("token", "weight")))).alias(f"{p}_map") for p in PARTS]
    return shared.groupBy(*dict.fromkeys([*kept, key])).agg(*maps)


def match_contexts(
    contexts: DataFrame,
    patterns: DataFrame,
    index: DataFrame,
    threshold: float,
    params: Params = Params(),
    key: str = "pattern_id",
    strict: bool = False,
) -> DataFrame:
    """The other columns of ``contexts``, which name a context, plus ``key`` and ``similarity`` of every match, each pair once.

    ``index`` is the :func:`pattern_index` of ``patterns`` at this threshold;
    whether a pattern is wide is asked once, so ``patterns`` should be staged.
    Tables of contexts and patterns that lack tokens bring the columns of :func:`with_norms`, both or none.
    """
    kept = [c for c in contexts.columns if c not in (*PARTS, *_GROUP, *OWN)]
    scored = score_pairs(_candidates(contexts, index, threshold, params, kept, key), contexts, patterns, threshold, params, key)
    reached = F.col("similarity") > threshold if strict else F.col("similarity") >= threshold
    return scored.where(reached)


def score_pairs(pairs: DataFrame, contexts: DataFrame, patterns: DataFrame, threshold: float, params: Params = Params(), key: str = "pattern_id") -> DataFrame:
    """``pairs``, of columns that name a context and ``key``, with ``similarity``; below ``threshold`` it may be NULL.

    Pairs with a wide pattern that share no token are left out.
    """
    kept = [c for c in pairs.columns if c != key]
    own = OWN if OWN[0] in contexts.columns else None
    wide = F.greatest(*(F.size(p) for p in PARTS)) > WIDE
    wide_patterns = patterns.where(wide)
    some_wide = wide_patterns.first() is not None
    if some_wide:
        pairs, patterns = stage(pairs, "candidates"), patterns.where(~wide)
    norms = [(F.col(o) if own else squared_norm(p)).alias(f"{p}_norm") for p, o in zip(PARTS, OWN)]
    tagged = [key, F.col("left_tag").alias("pattern_tag")]
    maps = [lookup(p).alias(f"{p}_map") for p in PARTS]
    joined = pairs.join(patterns.select(*tagged, *maps, *norms), key).join(contexts, kept)
    if some_wide:
        # Of these only the tokens that a context holds, too, come to it.
        met = pairs.join(wide_patterns.select(*tagged, *norms), key).join(contexts, kept)
        held = shared_weights(met, [*kept, key], wide_patterns, [key], key)
        joined = joined.unionByName(met.join(held, [*kept, key]).select(joined.columns))
    similarity = degree_of_match(
        "left_tag",
        PARTS,
        "pattern_tag",
        tuple(f"{p}_map" for p in PARTS),
        tuple(f"{p}_norm" for p in PARTS),
        params,
        at_least=threshold,
        own_norms=own,
    )
    # Exploding a list of one keeps the filter above the score, which is then computed once per candidate.
    return joined.select(*kept, key, F.explode_outer(F.array(similarity)).alias("similarity"))


def _postings(df: DataFrame, kept: list[str], prefix: str) -> DataFrame:
    """One row per token of each context, with the three squared norms."""
    items = ", ".join(f"transform({p}, x -> named_struct('part', '{p}', 'token', x.token, 'weight', x.weight))" for p in PARTS)
    norms = [squared_norm(p).alias(f"{prefix}_{p}") for p in PARTS]
    listed = df.select(*kept, "left_tag", signature().alias("signature"), *norms, F.expr(f"concat({items})").alias("items"))
    carried = [c for c in listed.columns if c != "items"]
    return listed.select(*carried, F.explode_outer("items").alias("x")).select(
        *carried, "x.part", "x.token", F.col("x.weight").alias(f"{prefix}_weight")
    )


def score_contexts(contexts: DataFrame, patterns: DataFrame, params: Params = Params(), key: str = "pattern_id") -> DataFrame:
    """``key`` and ``similarity`` of every pair that shares a token: a sparse matrix product.

    For low thresholds, where no token can be left out of an index. A context's
    products meet in one task and are summed there, so the shuffle carries one
    small row per pair and no vectors.
    """
    kept = [c for c in contexts.columns if c not in (*PARTS, "left_tag")]
    meeting = ["left_tag", "signature", "part", "token"]
    products = _postings(contexts, kept, "p").join(_postings(patterns, [key], "c"), meeting)
    norms = [F.max(f"{side}_{p}").alias(f"{side}_{p}") for side in "pc" for p in PARTS]
    dots = [F.sum(F.expr(f"if(part = '{p}', p_weight * c_weight, 0D)")).alias(f"dot_{p}") for p in PARTS]
    shared = F.sum(F.expr("if(part = 'rc', c_weight * c_weight, 0D)")).alias("shared")
    sums = products.groupBy(*kept, key).agg(*norms, *dots, shared)
    norm = {p: f"c_{p}" for p in PARTS}
    if not params.plain_cosine:
        norm["rc"] = "(c_rc + shared)"
    # The signatures agree, so a part is empty on both sides or on none.
    parts = " + ".join(f"coalesce(try_divide(dot_{p}, sqrt({norm[p]}) * sqrt(p_{p})), 0D)" for p in PARTS)
    return sums.select(*kept, key, F.expr(f"({parts}) / 3").alias("similarity"))


def _blocks(df: DataFrame, size: int, groups: DataFrame, *columns: str) -> DataFrame:
    """``(left_tag, signature, block, rows)``: rows of one group with their columns, dealt by a hash to lists of about ``size``.

    ``groups`` is ``(left_tag, signature, rows_in_all)``, at most 16 rows.
    """
    rows = df.withColumn("signature", signature()).join(F.broadcast(groups), _GROUP)
    block = F.pmod(F.xxhash64(*PARTS), F.ceil(F.col("rows_in_all") / size)).alias("block")
    return rows.groupBy(*_GROUP, block).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _groups(df: DataFrame) -> DataFrame:
    return df.select("left_tag", signature().alias("signature")).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows_in_all"))


def _entries(rows: pa.StructArray, part: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of one part of a block's vectors: how many tokens each has, all tokens and all weights."""
    lists = rows.field(part)
    flat = lists.flatten()
    return pa.compute.list_value_length(lists).to_numpy(), flat.field("token"), flat.field("weight").to_numpy()


def _block_similarities(contexts: pa.StructArray, patterns: pa.StructArray, damped: bool) -> np.ndarray:
    """Similarity of every context (row) of a block with every pattern (column) of another, both of one group.

    A part is empty on all sides or on none. Pattern weights stand in a matrix with a row for each token that the
    contexts hold, so work grows with the tokens of contexts times patterns, whichever tokens are frequent.
    """
    total = np.zeros((len(contexts), len(patterns)))
    for part in PARTS:
        sizes, tokens, weights = _entries(contexts, part)
        if not len(tokens):
            continue
        p_sizes, p_tokens, p_weights = _entries(patterns, part)
        owner = np.repeat(np.arange(len(patterns)), p_sizes)
        known = tokens.dictionary_encode()
        row = pa.compute.fill_null(pa.compute.index_in(p_tokens, known.dictionary), -1).to_numpy()
        matrix = np.zeros((len(known.dictionary), len(patterns)))
        matrix[row[row >= 0], owner[row >= 0]] = p_weights[row >= 0]
        at = known.indices.to_numpy()
        first = np.cumsum(sizes) - sizes
        dot = np.add.reduceat(weights[:, None] * matrix[at], first)
        norm = np.bincount(owner, p_weights * p_weights, len(patterns))
        if part == "rc" and damped:
            norm = norm + np.add.reduceat(matrix[at] ** 2, first)
        length = np.add.reduceat(weights * weights, first)
        total += dot / (np.sqrt(norm) * np.sqrt(length)[:, None])
    return total / 3


def similarity_counts(contexts: DataFrame, patterns: DataFrame, params: Params = Params()) -> DataFrame:
    """``(bucket, n)``, above bucket 0: how often (by ``n`` of the contexts) contexts and patterns have a similarity of so many tenths.

    A sparse matrix product in blocks: of a group of contexts with the same entity order and the same non-empty parts,
    blocks of contexts meet blocks of patterns, and a task counts its pairs at once, so no row is made for a pair and a
    token that every context holds weighs on no single task. Groups without patterns are left out before.
    """
    damped = not params.plain_cosine
    of_patterns = _groups(patterns)
    of_contexts = _groups(contexts).join(F.broadcast(of_patterns.select(*_GROUP)), _GROUP)
    share = F.pmod("block", F.lit(SHARES)).alias("share")
    left = _blocks(contexts, CONTEXT_BLOCK, of_contexts, *PARTS, "n").select(*_GROUP, share, F.col("rows").alias("contexts"))
    shares = F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")).alias("share")
    right = _blocks(patterns, PATTERN_BLOCK, of_patterns, *PARTS).select(*_GROUP, F.col("rows").alias("patterns"), shares)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(11, np.int64)
            for met, held in zip(batch.column("contexts"), batch.column("patterns")):
                tenths = np.floor(_block_similarities(met.values, held.values, damped) * 10 + 0.5)
                times = met.values.field("n").to_numpy()
                for bucket in range(1, 11):
                    sums[bucket] += times @ (tenths == bucket).sum(axis=1)
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums[found])], ["bucket", "n"])

    pairs = left.join(right, [*_GROUP, "share"]).select("contexts", "patterns")
    return pairs.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
