"""Word and tag statistics over text of the form ``word_TAG word_TAG ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.tagged import exploded


def split_words(tagged: DataFrame) -> DataFrame:
    """``(text)`` to ``(item)`` at single spaces; trailing empty items do not count."""
    items = F.when(F.rtrim("text") != "", F.split(F.rtrim("text"), " ")).when(
        F.col("text") == "", F.array(F.lit(""))
    )
    return exploded(tagged, [], items, "item")


def word_items(words: DataFrame) -> DataFrame:
    """``(word, tag)`` to ``(item)`` of the form ``word_TAG``."""
    return words.select(F.concat("word", F.lit("_"), "tag").alias("item"))


def word_tags(items: DataFrame, strict: bool = False) -> DataFrame:
    """``word_TAG`` items to ``(word, tag)``; pieces after the second are ignored.

    An item without a second piece fails the job in strict mode and is left out otherwise.
    """
    # An underscore before another character; pieces are found in the bytes, since a regular expression makes strings of every item.
    has_tag = F.contains(F.rtrim("item", F.lit("_")), F.lit("_"))
    word = F.substring_index("item", "_", 1)
    tag = F.substring_index(F.substring_index("item", "_", 2), "_", -1)
    if strict:
        broken = F.raise_error(F.concat(F.lit("item without a tag: "), F.col("item"))).cast("string")
        return items.select(
            F.when(has_tag, word).otherwise(broken).alias("word"), F.when(has_tag, tag).otherwise(broken).alias("tag")
        )
    return items.where(has_tag).select(word.alias("word"), tag.alias("tag"))


def word_tag_counts(pairs: DataFrame) -> DataFrame:
    """``(word, tag, n)``."""
    return pairs.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))


def word_tag_sorted(counts: DataFrame) -> DataFrame:
    """All counts in word order, ties by tag."""
    return counts.orderBy("word", "tag")


def top_tag_per_word(counts: DataFrame) -> DataFrame:
    """``(word, tag, n)`` with each word's most frequent tag; a tie goes to the first tag in order."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "tag")).alias("best")
    return counts.groupBy("word").agg(best).select("word", "best.tag", (-F.col("best.minus_n")).alias("n"))


def tags_per_word(pairs: DataFrame) -> DataFrame:
    """``(word, n)``: distinct tags of each word."""
    return pairs.dropDuplicates(["word", "tag"]).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def most_ambiguous_words(counted: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` words with the most distinct tags; ties in word order."""
    return counted.orderBy(F.desc("n"), "word").limit(k)
