"""The registered queries: every operator over the whole given tables, with flat columns.

Doubles are rounded to 6 places and vectors are shown as ``token=millionths`` lists,
so that two engines that add in different order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.vectors import PARTS, add_vectors, degree_of_match, squared_norm, vector_total
from pairloom.operators import postags, prepare, score, segments, wordstats
from pairloom.operators.cluster import centroids, cluster_patterns
from pairloom.operators.match import shared_weights
from pairloom.params import Params
from pairloom.plans.bootstrap import Round, bootstrap_relations, prepare_mentions
from pairloom.sources import format_relations, parse_articles, parse_seeds, union_lines
from pairloom.staging import stage
from pairloom.workload import corpus

Query = Callable[[SparkSession, str], DataFrame]

EXACT = Params(cluster_mode="exact")
TWO_LEVEL = Params(iterations=2)
EXACT_LOOP = Params(cluster_mode="exact", iterations=2)


def shown(vector: str) -> Column:
    """A context vector as text."""
    # Exact halves are common among shares; the offset keeps them off the rounding border.
    item = "concat(x.token, '=', CAST(CAST(floor(x.weight * 1000000 + 0.3D) AS BIGINT) AS STRING))"
    return F.expr(f"array_join(transform({vector}, x -> {item}), ' ')").alias(vector)


def rounded(name: str) -> Column:
    return F.round(name, 6).alias(name)


def joined(name: str) -> Column:
    """A list of tokens or positions as text."""
    return F.array_join(F.col(name).cast("array<string>"), "|").alias(name)


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.filter_by_tags(corpus.tagged_sentences(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.text_segments(_filtered(spark, sf_dir))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_articles(corpus.document_lines(spark, sf_dir))


def _document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = prepare.split_sentences(prepare.clean_newlines(_articles(spark, sf_dir)))
    name = F.concat(F.col("index").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    return sentences.select(name.alias("sentence_id"), "sentence")


def _tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document word as ``lowercase_SHAPE``, in one text per sentence."""
    # The shapes exclude one another, so the most frequent one is looked for first.
    tag = f"if(regexp_like(w, '^[a-z]+$'), 'NN', {corpus.SHAPE_TAG.format(like='regexp_like')})"
    items = F.expr(f"array_join(transform(split(sentence, ' '), w -> concat(lower(w), '_', {tag})), ' ')")
    return _document_sentences(spark, sf_dir).select(items.alias("text"))


def _word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.word_tags(wordstats.split_words(_tagged_text(spark, sf_dir)))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = wordstats.word_tag_counts(_word_tags(spark, sf_dir))
    return wordstats.top_tag_per_word(counts)


def _round(spark: SparkSession, sf_dir: str, params: Params = EXACT) -> Round:
    sentences = corpus.tagged_sentences(spark, sf_dir)
    seeds = stage(corpus.seed_pairs(spark, sf_dir), "seeds")
    return Round(prepare_mentions(sentences, params), seeds, params)


def _mentions(round_: Round) -> DataFrame:
    return round_.corpus.mentions


def scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_lines(corpus.document_lines(spark, sf_dir), corpus.conversation_lines(spark, sf_dir))


def parsed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir)


def parsed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_seeds(corpus.seed_lines(spark, sf_dir))


def formatted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_relations(corpus.supplier_nations(spark, sf_dir))


def clean_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.clean_newlines(_articles(spark, sf_dir))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.split_sentences(prepare.clean_newlines(_articles(spark, sf_dir)))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.clean_newlines(parse_articles(corpus.report_lines(spark, sf_dir)))


def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.learn_abbreviations(_reports(spark, sf_dir)).withColumn("score", rounded("score"))


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of articles with abbreviations, which are learned from the articles themselves."""
    articles = _reports(spark, sf_dir)
    return prepare.split_sentences(articles, stage(prepare.learn_abbreviations(articles), "abbreviations"))


def tag_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one and of two tokens."""
    return prepare.tag_entities(corpus.plain_sentences(spark, sf_dir), corpus.product_gazetteer(spark, sf_dir))


def tag_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.tag_entities(corpus.plain_sentences(spark, sf_dir), corpus.gazetteer(spark, sf_dir))


def _tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.tag_words(_document_sentences(spark, sf_dir), _lexicon(spark, sf_dir))


def _shown_tags(found: DataFrame) -> DataFrame:
    """``(sentence_id, tagged)``, lists of words and tags by id, as text. Sentences of equal ids become one, with their items in the order of places."""
    lists = F.transform("tagged", lambda x: F.zip_with(x["words"], x["tags"], lambda w, t: F.concat_ws("_", w, t)))
    rows = found.select("sentence_id", F.explode(F.array(lists)).alias("lists"))
    placed = F.flatten(F.transform("lists", lambda x: F.transform(x, lambda item, pos: F.struct(pos.alias("pos"), item.alias("item")))))
    items = F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(F.sort_array(placed)["item"])
    n = F.aggregate("lists", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x))
    return rows.select("sentence_id", n.alias("n_words"), F.array_join(items, " ").alias("tagged"))


def tag_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sentence, with its words and tags in order."""
    return _shown_tags(prepare.tag_words(_document_sentences(spark, sf_dir), _lexicon(spark, sf_dir), folded=True))


def _tag_model(spark: SparkSession, sf_dir: str) -> postags.TagModel:
    return postags.learn_tags(corpus.word_tagged_sentences(spark, sf_dir))


def tag_words_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each untagged sentence with its most probable tags, learned from other, tagged sentences."""
    return _shown_tags(postags.tag_sentences(corpus.plain_sentences(spark, sf_dir), _tag_model(spark, sf_dir), folded=True))


def tag_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each tag after each tag; null stands for the start and the end."""
    chain = _tag_model(spark, sf_dir).chain
    costs = chain.select("names", F.posexplode("costs").alias("at", "cost"))
    side = lambda at: F.expr(f"get(names, CAST({at} AS INT))")
    return costs.select(side("at div (size(names) + 1)").alias("before"), side("at % (size(names) + 1)").alias("tag"), "cost")


def filter_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)


def org_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.org_sentences(_filtered(spark, sf_dir))


def tokenize_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = segments.tokenize(_filtered(spark, sf_dir))
    return tokens.select("sentence_id", F.posexplode("tokens").alias("pos", "t")).select("sentence_id", "pos", "t.*")


def mention_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = segments.mention_sites(segments.tokenize(_filtered(spark, sf_dir)))
    return sites.select("sentence_id", joined("org_sites"), joined("loc_sites"))


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.entity_pairs(segments.tokenize(_filtered(spark, sf_dir)))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = segments.context_windows(_filtered(spark, sf_dir))
    return windows.select("sentence_id", "a", "b", "occurrences", joined("lw"), joined("mw"), joined("rw"))


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select(
        "sentence_id", "a", "b", "org", "loc", "left_tag", "occurrences", *(shown(p) for p in PARTS)
    )


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = segments.context_windows(_filtered(spark, sf_dir))
    vectors = segments.with_vectors(windows)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("vector")) for p in PARTS))
    return (
        vectors.select("sentence_id", "a", "b", F.explode(parts).alias("v"))
        .select("sentence_id", "a", "b", "v.part", F.explode("v.vector").alias("x"))
        .select("sentence_id", "a", "b", "part", "x.token", F.round("x.weight", 6).alias("weight"))
    )


def summed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left and right context of every segment added up, with the total weight."""
    both = _segments(spark, sf_dir).select("sentence_id", "a", "b", add_vectors("lc", "rc").alias("vector"))
    return both.select("sentence_id", "a", "b", shown("vector"), F.round(vector_total("vector"), 6).alias("total"))


def sentence_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    organizations = segments.org_sentences(_filtered(spark, sf_dir))
    return segments.sentence_seed_join(organizations, corpus.seed_pairs(spark, sf_dir))


def raw_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentioned = segments.mentions(corpus.tagged_sentences(spark, sf_dir))
    raw = segments.raw_patterns(mentioned, corpus.seed_pairs(spark, sf_dir))
    return raw.select("left_tag", *(shown(p) for p in PARTS), "weight")


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.split_words(_tagged_text(spark, sf_dir))


def word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_tags(spark, sf_dir)


def word_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.word_tag_counts(_word_tags(spark, sf_dir))


def article_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From articles to counts, with the tags of the lexicon."""
    return wordstats.word_tag_counts(wordstats.word_tags(wordstats.word_items(_tagged_words(spark, sf_dir))))


def word_tag_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.word_tag_sorted(word_tag_counts(spark, sf_dir))


def top_tag_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.top_tag_per_word(word_tag_counts(spark, sf_dir))


def tags_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.tags_per_word(_word_tags(spark, sf_dir))


def most_ambiguous_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordstats.most_ambiguous_words(tags_per_word(spark, sf_dir))


def centroid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centroid per location and entity order."""
    found = _segments(spark, sf_dir).withColumn("cluster_id", F.concat_ws("|", "loc", "left_tag"))
    return centroids(found).select("cluster_id", "left_tag", *(shown(p) for p in PARTS))


def degrees_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct context of a location against both centroids of that location."""
    folded = _segments(spark, sf_dir).groupBy("loc", "left_tag", *PARTS).agg(F.count(F.lit(1)).alias("n"))
    identity = ["loc", "left_tag", *(x for p in PARTS for x in (F.size(p), p))]
    key = [F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit("context"), *identity).alias("k2")]
    # The sentences are read once; a context stands for its n segments in the sums.
    contexts = stage(folded.select("*", *key), "located")
    times = [F.expr(f"transform({p}, x -> named_struct('token', x.token, 'weight', x.weight * n))").alias(p) for p in PARTS]
    members = contexts.select(F.concat_ws("|", "loc", "left_tag").alias("cluster_id"), "left_tag", *times)
    centers = stage(centroids(members).withColumn("loc", F.split_part("cluster_id", F.lit("|"), F.lit(1))), "centers")
    # A centroid holds the vocabulary of a location: only the weights of a context's own tokens come to it.
    held = shared_weights(contexts, ["k1", "k2"], centers, ["loc"], "cluster_id")
    norms = [squared_norm(p).alias(f"{p}_norm") for p in PARTS]
    pairs = contexts.join(centers.select("cluster_id", F.col("left_tag").alias("centroid_tag"), "loc", *norms), "loc")
    pairs = pairs.join(held, ["k1", "k2", "cluster_id"], "left")
    nothing = F.expr("map_from_entries(CAST(array() AS ARRAY<STRUCT<token: STRING, weight: DOUBLE>>))")
    pairs = pairs.withColumns({f"{p}_map": F.coalesce(f"{p}_map", nothing) for p in PARTS})
    similarity = degree_of_match(
        "left_tag", PARTS, "centroid_tag", tuple(f"{p}_map" for p in PARTS), tuple(f"{p}_norm" for p in PARTS)
    )
    return pairs.select("cluster_id", "left_tag", *(shown(p) for p in PARTS), F.round(similarity, 6).alias("similarity"))


def exact_pattern_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentioned = segments.mentions(corpus.tagged_sentences(spark, sf_dir))
    raw = segments.raw_patterns(mentioned, corpus.seed_pairs(spark, sf_dir))
    clusters = cluster_patterns(raw, EXACT)
    return clusters.select("left_tag", *(shown(p) for p in PARTS), "size", "copies")


def pattern_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    level1 = _round(spark, sf_dir, TWO_LEVEL).level1
    return level1.select("left_tag", *(shown(p) for p in PARTS), "size", "copies")


def final_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = _round(spark, sf_dir, TWO_LEVEL).patterns
    return patterns.select("pattern_id", "left_tag", *(shown(p) for p in PARTS), "size")


def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _round(spark, sf_dir)
    windows = _mentions(step).select(*segments.CONTEXT_KEY, "org", "loc", "left_tag", joined("lw"), joined("mw"), joined("rw"), "n")
    return windows.join(step.matches, segments.CONTEXT_KEY).drop(*segments.CONTEXT_KEY).withColumn("similarity", rounded("similarity"))


def match_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _round(spark, sf_dir)
    matched = score.match_seed_join(score.pattern_matches(_mentions(step), step.matches, step.corpus.hot), step.seeds, step.corpus.hot)
    return matched.groupBy("org", "loc", "seed_loc", "pattern_id").agg(F.sum("n").alias("n"))


def pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).support


def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).confidence.withColumn("confidence", rounded("confidence"))


def best_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _round(spark, sf_dir)
    windows = _mentions(step).select(*segments.CONTEXT_KEY, "left_tag", joined("lw"), joined("mw"), joined("rw")).distinct()
    return windows.join(step.best, segments.CONTEXT_KEY).drop(*segments.CONTEXT_KEY).withColumn("similarity", rounded("similarity"))


def candidate_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _round(spark, sf_dir).candidates
    return candidates.select("org", "loc", rounded("pattern_confidence"), rounded("similarity"), "n").groupBy(
        "org", "loc", "pattern_confidence", "similarity"
    ).agg(F.sum("n").alias("n"))


def tuple_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).tuples.withColumn("confidence", rounded("confidence"))


def filtered_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.filtered_tuples(_round(spark, sf_dir).tuples).withColumn("confidence", rounded("confidence"))


def new_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).found


def merged_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).merged


def hist_match_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).match_histogram()


def hist_tuple_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).tuple_histogram()


def hist_cluster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir, TWO_LEVEL).join_histogram()


def exact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the loop with exact clustering."""
    return bootstrap_relations(
        corpus.tagged_sentences(spark, sf_dir), corpus.seed_pairs(spark, sf_dir), EXACT_LOOP
    ).relations


def bootstrapped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the loop with two-level clustering: the flagship."""
    return bootstrap_relations(
        corpus.tagged_sentences(spark, sf_dir), corpus.seed_pairs(spark, sf_dir), TWO_LEVEL
    ).relations


def iteration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_relations(
        corpus.tagged_sentences(spark, sf_dir), corpus.seed_pairs(spark, sf_dir), TWO_LEVEL
    ).metrics.drop("seconds")


def prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = parse_articles(corpus.sentence_lines(spark, sf_dir))
    return prepare.prepare_corpus(articles, corpus.gazetteer(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "scan_union": scan_union,
    "parse_articles": parsed_articles,
    "parse_seeds": parsed_seeds,
    "format_relations": formatted_relations,
    "clean_newlines": clean_newlines,
    "split_sentences": split_sentences,
    "abbreviations": abbreviations,
    "report_sentences": report_sentences,
    "tag_entities": tag_entities,
    "tag_products": tag_products,
    "tag_words": tag_words,
    "tag_words_in_context": tag_words_in_context,
    "tag_costs": tag_costs,
    "filter_by_tags": filter_by_tags,
    "org_sentences": org_sentences,
    "tokenize_tagged": tokenize_tagged,
    "mention_sites": mention_sites,
    "entity_pairs": entity_pairs,
    "context_windows": context_windows,
    "text_segments": text_segments,
    "context_vectors": context_vectors,
    "add_vectors": summed_vectors,
    "sentence_seed_join": sentence_seed_join,
    "raw_patterns": raw_patterns,
    "split_words": split_words,
    "word_tags": word_tags,
    "word_tag_counts": word_tag_counts,
    "article_word_counts": article_word_counts,
    "word_tag_sorted": word_tag_sorted,
    "top_tag_per_word": top_tag_per_word,
    "tags_per_word": tags_per_word,
    "most_ambiguous_words": most_ambiguous_words,
    "centroids": centroid_vectors,
    "degree_of_match": degrees_of_match,
    "exact_pattern_clusters": exact_pattern_clusters,
    "pattern_clusters": pattern_clusters,
    "final_patterns": final_patterns,
    "pattern_matches": pattern_matches,
    "match_seed_join": match_seed_join,
    "pattern_support": pattern_support,
    "pattern_confidence": pattern_confidence,
    "best_pattern": best_pattern,
    "candidate_tuples": candidate_tuples,
    "tuple_confidence": tuple_confidence,
    "filtered_tuples": filtered_tuples,
    "new_seeds": new_seeds,
    "merged_seeds": merged_seeds,
    "hist_match_similarity": hist_match_similarity,
    "hist_tuple_confidence": hist_tuple_confidence,
    "hist_cluster_similarity": hist_cluster_similarity,
    "exact_relations": exact_relations,
    "bootstrap_relations": bootstrapped_relations,
    "iteration_metrics": iteration_metrics,
    "prepare_corpus": prepare_corpus,
}
