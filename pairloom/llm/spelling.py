"""Spelling variant grouping with asymmetric q-chunks.

Of two words that differ by one edit, the shorter one (either, of equal lengths) contributes two disjoint chunks, its halves, and the
other its positional grams of the same lengths. The edit falls into one half at most, so the other half stands whole in the longer
word, moved by one place at most: the first half at the start, the second half at the end. Only the grams at these places can meet a
surviving chunk, so only they are joined, on (length of the shorter word, half, text). Candidates are verified by their edit distance.
A pair of which both halves survive (an insertion between them) meets twice and counts for the first half alone.

Counts, candidates and links are aggregated and joined by Spark; the rows of a frequent half are dealt out by the skew join. Roots are
found by pointer doubling: along a chain of forms the number of occurrences grows tenfold with every step, so a chain is short.

Defined results: a null text has no words; a null key counts as an empty one in the deletion hash; repeated rows count as often as they
stand; of equally frequent near words the first in code-point order is the form; no words give no rows. Texts and words of any length
are taken whole. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import LOWER, UPPER, column, staged

#: Letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
#: One of so many occurrences loses a letter.
DELETED_OF = 31


def damaged(run: Column, key: Column, one_of: int = DELETED_OF) -> Column:
    """The run without one code point where the hash of key and run says so, else the run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(h % one_of == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts after damage, with their occurrences."""
    # A run can only get shorter, so shorter ones are left out where they are found.
    runs = F.regexp_extract_all(column(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(column(id_col).alias("key"), F.explode(runs).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = rows.select("key", run.alias("run")).select(damaged(F.col("run"), F.col("key")).alias("word"))
    counts = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def chunks(words: DataFrame) -> DataFrame:
    """size, half, part, word, n: both halves of every word."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    first = F.struct(F.lit(0).alias("half"), F.substr("word", F.lit(1), half).alias("part"))
    second = F.struct(F.lit(1).alias("half"), F.substr("word", half + 1).alias("part"))
    return words.select(size.alias("size"), F.explode(F.array(first, second)).alias("x"), "word", "n").select("size", "x.*", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """size, half, part, other, m: the grams of every word where a half of a word of the same or the next smaller size can stand."""
    length = F.length("word")
    found = []
    for less in (0, 1):
        size = length - less
        half = F.floor(size / 2).cast("int")
        found.append(F.struct(size.alias("size"), F.lit(0).alias("half"), F.substr("word", F.lit(1), half).alias("part")))
        found.append(F.struct(size.alias("size"), F.lit(1).alias("half"), F.substr("word", half + 1 + less).alias("part")))
    return words.select(F.explode(F.array(*found)).alias("x"), F.col("word").alias("other"), F.col("n").alias("m")).select("x.*", "other", "m")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, m: every two words of distance one, once; the shorter one (the smaller, of equal lengths) is `word`."""
    left, right = chunks(words).alias("a"), grams(words).alias("b")
    word, other = F.col("a.word"), F.col("b.other")
    ordered = (F.length(other) > F.length(word)) | (word < other)
    half = F.floor(F.col("a.size") / 2).cast("int")
    once = (F.col("a.half") == 0) | (F.substr(word, F.lit(1), half) != F.substr(other, F.lit(1), half))
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.part") == F.col("b.part"))
    met = left.join(right, same & ordered & once & (F.levenshtein(word, other, 1) == 1))
    return met.select("a.word", "a.n", "b.other", "b.m")


def with_roots(forms: DataFrame, largest: int) -> DataFrame:
    """word, form, root of the rows (word, form); `largest` is the greatest number of occurrences."""
    steps = max(1, math.floor(math.log(max(largest, LEAST_COUNT) / LEAST_COUNT, LEAST_RATIO)))
    found = forms.select("word", "form", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        found = staged(found)
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = found.join(onward, "root", "left").select("word", "form", F.coalesce("further", "root").alias("root"))
    return found


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: all words with their most frequent near word, where that is LEAST_RATIO times as frequent."""
    words = staged(word_counts(docs, id_col=id_col, text_col=text_col))
    pairs = near_pairs(words)
    both = F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("m").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    links = pairs.select(F.explode(both).alias("x")).select("x.*")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    best = staged(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n")))
    enough = F.col("near_n") >= LEAST_RATIO * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    rows = staged(rows)
    largest = words.agg(F.max("n")).first()[0] or 0
    roots = with_roots(rows.where("form IS NOT NULL").select("word", "form"), largest).select("word", "root")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
