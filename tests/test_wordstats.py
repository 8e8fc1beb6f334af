from __future__ import annotations

import re

import pytest

from pairloom.operators import wordstats


def items(spark, *texts):
    return wordstats.split_words(spark.createDataFrame([(t,) for t in texts], "text STRING"))


def test_split_keeps_inner_and_drops_trailing_blanks(spark):
    assert [r.item for r in items(spark, " a  b ").collect()] == ["", "a", "", "b"]
    assert [r.item for r in items(spark, "").collect()] == [""]
    assert items(spark, "   ").count() == 0


def test_pairs(spark):
    got = wordstats.word_tags(items(spark, "a_X b_Y_Z c d_ e__F _G")).collect()
    assert [(r.word, r.tag) for r in got] == [("a", "X"), ("b", "Y"), ("e", ""), ("", "G")]
    with pytest.raises(Exception, match="item without a tag: c"):
        wordstats.word_tags(items(spark, "a_X c"), strict=True).collect()


def test_statistics(spark):
    pairs = wordstats.word_tags(items(spark, "a_X a_Y a_Y b_X b_Z b_Z b_X c_X a_W"))
    counts = wordstats.word_tag_counts(pairs)
    assert [tuple(r) for r in wordstats.word_tag_sorted(counts).collect()] == [
        ("a", "W", 1), ("a", "X", 1), ("a", "Y", 2), ("b", "X", 2), ("b", "Z", 2), ("c", "X", 1),
    ]
    assert sorted(tuple(r) for r in wordstats.top_tag_per_word(counts).collect()) == [
        ("a", "Y", 2), ("b", "X", 2), ("c", "X", 1),
    ]
    per_word = wordstats.tags_per_word(pairs)
    assert [tuple(r) for r in wordstats.most_ambiguous_words(per_word, 2).collect()] == [("a", 3), ("b", 2)]


def test_top_k_sorts_only_k_rows(spark):
    per_word = wordstats.tags_per_word(wordstats.word_tags(items(spark, "a_X")))
    plan = wordstats.most_ambiguous_words(per_word)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_word_tags_of_odd_items_without_regular_expressions(spark):
    items = [None, "", "_", "__", "a", "a_", "_a", "a_b", "a_b_", "a__b", "a_b_c", "_\n", "\n_", "a_\u00e9", "\u4e2d_x_y"]
    found = wordstats.word_tags(spark.createDataFrame([(x,) for x in items], "item string"))
    expected = [tuple(x.split("_")[:2]) for x in items if x and re.search("_[^_]", x)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "split(" not in plan
