"""Tags by context: against every possible path, on held-out sentences, and on odd input."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from conftest import TINY

from pairloom.operators import postags
from pairloom.workload import queries

TAGGED = [
    "the_DT rose_NN fell_VBD ._.",
    "prices_NNS rose_VBD ._.",
    "the_DT fall_NN hurt_VBD ._.",
    "they_PRP fall_VB ._.",
    "a_DT rose_NN rose_VBD ._.",
    "they_PRP hurt_VBD the_DT rose_NN ._.",
    "prices_NNS fall_VB and_CC fell_VBD ._.",
    "50_CD prices_NNS jumped_VBD ._.",
]


def learned(spark, texts):
    return postags.learn_tags(spark.createDataFrame([(t,) for t in texts], "text STRING"))


def tagged(sentences, model, *texts):
    rows = postags.tag_in_context(sentences(*texts), model).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.sentence_id, r.pos)):
        found.setdefault(r.sentence_id, []).append((r.word, r.tag))
    return [found.get(f"s{i:04d}", []) for i in range(len(texts))]


def cost(share):
    return round(-math.log(share) * postags.UNIT)


def every_path(texts, words, shapes):
    """The tags of least cost among all sequences of the words' possible tags, from counts taken in Python.

    ``shapes`` gives the shapes of a word from the finest to the coarsest."""
    pairs = [[tuple(i.rsplit("_", 1)) for i in t.split()] for t in texts]
    counts = Counter(p for s in pairs for p in s)
    of_tag, kinds = Counter(), Counter()
    for (_, t), n in counts.items():
        of_tag[t] += n
        kinds[t] += 1
    steps = Counter(x for s in pairs for x in itertools.pairwise([None, *(t for _, t in s), None]))
    after = Counter()
    for (a, _), n in steps.items():
        after[a] += n

    def step(a, b):
        return cost((steps[a, b] + 1) / (after[a] + len(of_tag) + 1))

    def possible(word):
        known = {t: n for (w, t), n in counts.items() if w == word}
        for shape in () if known else shapes(word):
            if not known:
                known = Counter(t for w, t in counts if shape in shapes(w))
        return {t: cost(n / (of_tag[t] + kinds[t])) for t, n in known.items()}

    best = None
    options = [sorted(possible(w).items()) for w in words]
    for path in itertools.product(*options):
        chain = [None, *(t for t, _ in path), None]
        total = sum(c for _, c in path) + sum(step(a, b) for a, b in itertools.pairwise(chain))
        # of equal costs the lowest tags, the last word first
        key = (total, [t for t, _ in path[::-1]])
        if best is None or key < best:
            best = key
    return best[1][::-1]


def shapes(word):
    if word.isdigit():
        return ["number", ""]
    if not any(c.isalnum() for c in word):
        return ["mark", ""]
    if word.isalpha() and word.islower():
        return [f"lower-{word[-2:]}", "lower", ""]
    if word.isalpha() and word.istitle() and len(word) > 1:
        return ["capital", ""]
    if word.isalpha() and word.isupper():
        return ["upper", ""]
    return ["other", ""]


def test_best_of_all_paths(spark, sentences):
    chance = random.Random(4)
    vocabulary = [f"{c}{d}" for c in "abcd" for d in "xyz"]
    texts = [" ".join(f"{chance.choice(vocabulary)}_{chance.choice('ABC')}" for _ in range(chance.randint(1, 5))) for _ in range(25)] + ["stop_S ._S"]
    asked = [" ".join(chance.choice([*vocabulary, ".", "stop", "new", "Xy", "17", "x1", "!"]) for _ in range(chance.randint(1, 7))) for _ in range(40)]
    got = tagged(sentences, learned(spark, texts), *asked)
    for text, pairs in zip(asked, got, strict=True):
        assert [w for w, _ in pairs] == text.split(" ")
        assert [t for _, t in pairs] == every_path(texts, text.split(" "), shapes), text


def test_the_same_word_by_its_neighbours(spark, sentences):
    got = tagged(sentences, learned(spark, TAGGED), "the rose rose .", "prices fall .", "the fall hurt prices .", "they climbed .")
    assert [t for _, t in got[0]] == ["DT", "NN", "VBD", "."]
    assert [t for _, t in got[1]] == ["NNS", "VB", "."]
    assert [t for _, t in got[2]] == ["DT", "NN", "VBD", "NNS", "."]
    assert got[3][1] == ("climbed", "VBD")  # by its ending


def test_more_right_than_the_most_frequent_tag(spark, sentences):
    """Held-out sentences of a grammar in which half of the words have two tags."""
    chance = random.Random(1)
    both = [f"w{i}x" for i in range(20)]

    def sentence():
        noun, verb = chance.choice(both), chance.choice(both)
        return [("the", "DT"), (noun, "NN"), ("will", "MD"), (verb, "VB"), (".", ".")]

    train, held = [[sentence() for _ in range(n)] for n in (300, 60)]
    model = learned(spark, [" ".join(f"{w}_{t}" for w, t in s) for s in train])
    got = tagged(sentences, model, *(" ".join(w for w, _ in s) for s in held))
    assert got == held
    alone = Counter(p for s in train for p in s)
    frequent = [[max("NN VB DT MD .".split(), key=lambda t, w=w: alone[w, t]) for w, _ in s] for s in held]
    assert sum(f != [t for _, t in s] for f, s in zip(frequent, held, strict=True)) > 20


def test_odd_sentences(spark):
    model = learned(spark, [*TAGGED, None, "", "broken _X y_", "un_der_NN"])
    assert "un_der" in {r.word for r in model.words.collect()} and "y" not in {r.word for r in model.words.collect()}
    rows = [("a", None), ("b", ""), (None, "the rose"), ("c", "the rose"), ("c", "the rose"), ("c", "they fall")]
    got = postags.tag_in_context(spark.createDataFrame(rows, "sentence_id STRING, sentence STRING"), model).collect()
    assert sorted((str(r.sentence_id), r.pos, r.word, r.tag) for r in got if r.sentence_id != "b") == sorted(
        [("None", 0, "the", "DT"), ("None", 1, "rose", "NN")]
        + 2 * [("c", 0, "the", "DT"), ("c", 1, "rose", "NN")]
        + [("c", 0, "they", "PRP"), ("c", 1, "fall", "VB")]
    )
    assert [(r.pos, r.word) for r in got if r.sentence_id == "b"] == [(0, "")]


def test_nothing_learned_or_asked(spark, sentences):
    empty = learned(spark, [])
    assert tagged(sentences, empty, "a b") == [[("a", None), ("b", None)]]
    none = spark.createDataFrame([], "sentence_id STRING, sentence STRING")
    assert postags.tag_in_context(none, learned(spark, TAGGED)).collect() == []


def test_very_long_sentence(spark, sentences):
    n = 10_000
    (got,) = tagged(sentences, learned(spark, TAGGED), "the rose rose . " * n)
    assert [t for _, t in got[:-1]] == ["DT", "NN", "VBD", "."] * n


def test_too_many_tags(spark):
    with pytest.raises(Exception, match="different tags"):
        learned(spark, [f"w_T{i}" for i in range(postags.MOST_TAGS + 1)])


def test_rare_words_by_a_join(spark, sentences, monkeypatch):
    """With two frequent words the tags of the others come by a join, also to repeated rows, and are those of all paths."""
    monkeypatch.setattr(postags, "FREQUENT_WORDS", 2)
    chance = random.Random(7)
    vocabulary = [f"{c}{d}" for c in "abcd" for d in "xyz"]
    texts = [" ".join(f"{chance.choice(vocabulary)}_{chance.choice('ABC')}" for _ in range(chance.randint(1, 5))) for _ in range(25)] + ["stop_S ._S"]
    asked = [" ".join(chance.choice([*vocabulary, ".", "stop", "new"]) for _ in range(chance.randint(1, 6))) for _ in range(10)]
    model = learned(spark, texts)
    for text, pairs in zip(asked, tagged(sentences, model, *asked), strict=True):
        assert pairs == list(zip(text.split(" "), every_path(texts, text.split(" "), shapes), strict=True))
    twice = spark.createDataFrame([("a", "ax bx stop")] * 2 + [("a", "cx")], "sentence_id STRING, sentence STRING")
    got = postags.tag_sentences(twice, model).collect()
    assert sorted(r.words for r in got) == [["ax", "bx", "stop"]] * 2 + [["cx"]] and all(None not in r.tags for r in got)


def test_sentences_stay_rows(spark, sentences):
    """Where all words are frequent no word is shuffled; a word for a row took two shuffles before."""
    found = postags.tag_in_context(sentences("the rose rose .", "they climbed ."), learned(spark, TAGGED))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_run_in_linear_time(spark, sentences):
    """30,000 words without one of a single tag: their path was copied at every word before."""
    (got,) = tagged(sentences, learned(spark, TAGGED), " ".join(["rose"] * 30_000))
    assert len(got) == 30_000 and {t for _, t in got} <= {"NN", "VBD"}


def test_items_at_the_last_underscore(spark):
    texts = ["a_b_X  c_Y _Z d_ e f\n_V g_W\n h\r1_V", "", None, "i_V"]
    model = learned(spark, texts)
    assert sorted((r.word, r.n) for r in model.words.collect()) == [("a_b", 1), ("c", 1), ("g", 1), ("i", 1)]
    assert model.chain.first().names == ["V", "W\n", "X", "Y"]


def test_shapes_are_those_of_spark(spark):
    words = [w + e for w in ("17", "1.5", "abc", "a", "Abc", "ABC", "?!", "x1", "") for e in ("", "\n", "\r", "\r\n", "\n\n", " ", "\u0085b", "\n\r")]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", postags.shape_of("w").alias("s")).collect()
    assert [(r.w, postags._shapes(r.w)[0]) for r in rows] == [(r.w, r.s) for r in rows]


def test_folded_by_id(spark, monkeypatch):
    """Sentences of one id in one row, each tagged alone, also where most words come by a join."""
    rows = [("a", "the rose rose ."), ("a", "they fall"), ("a", "they fall"), ("b", "the rose rose ."), (None, "fall"), ("c", None), ("d", "")]
    asked = spark.createDataFrame(rows, "sentence_id STRING, sentence STRING")
    model = learned(spark, TAGGED)
    alone = {r.sentence_id: [] for r in asked.where("sentence IS NOT NULL").collect()}
    for r in postags.tag_sentences(asked, model).collect():
        alone[r.sentence_id].append((r.words, r.tags))
    for frequent in (postags.FREQUENT_WORDS, 2):
        monkeypatch.setattr(postags, "FREQUENT_WORDS", frequent)
        got = postags.tag_sentences(asked, model, folded=True).collect()
        assert len(got) == len(alone)
        assert {r.sentence_id: sorted((x.words, x.tags) for x in r.tagged) for r in got} == {k: sorted(v) for k, v in alone.items()}


def test_plain_text_is_shuffled_not_tagged(spark):
    """Sentences of one id meet before they are tagged; their tagged items were shuffled before."""
    plan = queries.tag_words_in_context(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]


def test_sentences_are_shuffled_once(spark, monkeypatch):
    """Rows come to their answers by the key they are dealt by; each sentence went through three shuffles before."""
    monkeypatch.setattr(postags, "FREQUENT_WORDS", 2)
    asked = spark.createDataFrame([(str(i), "the rose rose .") for i in range(40)], "sentence_id STRING, sentence STRING")
    found = postags.tag_sentences(asked, learned(spark, TAGGED), folded=True)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and sum("Exchange hashpartitioning" in line and "sentence#" in line for line in plan.splitlines()) <= 1
