"""The jobs from files to files: extraction, preparation and word statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import postags, wordstats
from pairloom.operators.postags import learn_tags
from pairloom.operators.prepare import clean_newlines, learn_abbreviations, prepare_corpus, split_sentences, tag_words
from pairloom.params import Params
from pairloom.plans.bootstrap import Extraction, bootstrap_relations
from pairloom.sources import parse_articles, parse_seeds, read_lines, rejected_articles, write_relations, write_table
from pairloom.staging import stage


def _numbered(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(F.monotonically_increasing_id().alias("sentence_id"), F.col(column).alias("sentence"))


def _articles(lines: DataFrame, output: str) -> DataFrame:
    """The articles; lines that are none are kept in a folder beside the output."""
    write_table(rejected_articles(lines), f"{output.rstrip('/')}-rejected", format="text")
    return parse_articles(lines)


def _prepared(lines: DataFrame, output: str, gazetteer: DataFrame, abbreviations: bool) -> DataFrame:
    """Tagged sentences of the articles, whose abbreviations are learned first if wanted."""
    articles = _articles(lines, output)
    held = stage(learn_abbreviations(clean_newlines(articles)), "abbreviations") if abbreviations else None
    return prepare_corpus(articles, gazetteer, held)


def extract_relations(
    spark: SparkSession,
    inputs: str | Sequence[str],
    seeds: str,
    output: str,
    params: Params = Params(),
    gazetteer: DataFrame | None = None,
    format: str = "text",
    abbreviations: bool = False,
) -> Extraction:
    """Read sentences and seeds, run the loop, write the pairs.

    ``inputs`` hold one tagged sentence per line or, if a ``gazetteer`` is
    given, one tab-separated article per line. With ``abbreviations`` those are
    learned from the articles, and their full stops end no sentence.
    """
    lines = read_lines(spark, inputs)
    if gazetteer is None:
        sentences = _numbered(lines, "line")
    else:
        sentences = _numbered(_prepared(lines, output, gazetteer, abbreviations), "sentence")
    extraction = bootstrap_relations(sentences, parse_seeds(read_lines(spark, seeds)), params)
    write_relations(extraction.relations, output, format)
    return extraction


def tag_articles(
    spark: SparkSession, inputs: str | Sequence[str], gazetteer: DataFrame, output: str, abbreviations: bool = False
) -> None:
    """Tab-separated articles to files with one tagged sentence per line; ``abbreviations`` as in :func:`extract_relations`."""
    sentences = _prepared(read_lines(spark, inputs), output, gazetteer, abbreviations)
    write_table(sentences.select("sentence"), output, format="text")


def _tagged_words(lines: DataFrame, lexicon: DataFrame, output: str, default_tag: str) -> DataFrame:
    sentences = split_sentences(clean_newlines(_articles(lines, output)))
    return tag_words(sentences.select(F.struct("index", "pos").alias("sentence_id"), "sentence"), lexicon, default_tag)


def tag_parts_of_speech(
    spark: SparkSession, inputs: str | Sequence[str], lexicon: DataFrame, output: str, default_tag: str = "NN"
) -> None:
    """Tab-separated articles to ``(index, pos, word, tag)`` with each word's tag from the lexicon."""
    words = _tagged_words(read_lines(spark, inputs), lexicon, output, default_tag)
    write_table(words.select("sentence_id.index", F.col("sentence_id.pos").alias("sentence"), "pos", "word", "tag"), output)


def tag_in_context(spark: SparkSession, inputs: str | Sequence[str], tagged: str | Sequence[str], output: str) -> None:
    """Tab-separated articles to ``(index, sentence, pos, word, tag)``, tags by the words around, learned from lines of ``word_TAG`` items."""
    model = learn_tags(read_lines(spark, tagged).withColumnRenamed("line", "text"))
    sentences = split_sentences(clean_newlines(_articles(read_lines(spark, inputs), output)))
    words = postags.tag_in_context(sentences.select(F.struct("index", "pos").alias("sentence_id"), "sentence"), model)
    write_table(words.select("sentence_id.index", F.col("sentence_id.pos").alias("sentence"), "pos", "word", "tag"), output)


def _statistics(items: DataFrame, best_tag: str, most_tags: str, k: int) -> DataFrame:
    pairs = wordstats.word_tags(items)
    write_table(wordstats.word_tag_sorted(wordstats.word_tag_counts(pairs)), best_tag, format="text")
    per_word = wordstats.tags_per_word(pairs)
    write_table(per_word, most_tags, format="text")
    return wordstats.most_ambiguous_words(per_word, k)


def article_statistics(
    spark: SparkSession,
    inputs: str | Sequence[str],
    lexicon: DataFrame,
    best_tag: str,
    most_tags: str,
    k: int = 10,
    default_tag: str = "NN",
) -> DataFrame:
    """:func:`word_statistics` straight from tab-separated articles, each word's tag from the lexicon."""
    words = _tagged_words(read_lines(spark, inputs), lexicon, best_tag, default_tag)
    return _statistics(wordstats.word_items(words), best_tag, most_tags, k)


def word_statistics(
    spark: SparkSession, inputs: str | Sequence[str], best_tag: str, most_tags: str, k: int = 10
) -> DataFrame:
    """Lines of ``word_TAG`` items to two text outputs; returns the ``k`` most ambiguous words.

    ``best_tag`` receives all tag counts in word order, ``most_tags`` the number
    of distinct tags per word.
    """
    tagged = read_lines(spark, inputs).withColumnRenamed("line", "text")
    return _statistics(wordstats.split_words(tagged), best_tag, most_tags, k)
