from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import TINY
from pyspark.sql import functions as F

from pairloom.functions.sentences import count_words
from pairloom.functions.tagged import bare, exploded, spaced_words, with_full_stop
from pairloom.operators import prepare
from pairloom.sources import parse_articles
from pairloom.workload import queries


def split(spark, text):
    rows = prepare.split_sentences(spark.createDataFrame([(1, text)], "index INT, text STRING")).collect()
    return [r.sentence for r in sorted(rows, key=lambda r: r.pos)]


def articles(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "index INT, text STRING")


def test_abbreviations_belong_to_their_word(spark):
    held = spark.createDataFrame([("mr",), ("inc",), ("u.s",), ("mr",)], "word STRING")
    texts = ["Mr. Smith fell. He (Mr. Jones of Acme Inc.) met the U.S., then left.", "No Mr, here. MR. X of Acme Inc.", None, "", "One. Two.", "One. Two."]
    got = prepare.split_sentences(articles(spark, *texts), held).collect()
    found = {i: [r.sentence for r in sorted(got, key=lambda r: r.pos) if r["index"] == i] for i in range(6)}
    assert found[0] == ["Mr. Smith fell .", "He ( Mr. Jones of Acme Inc. ) met the U.S. , then left ."]
    assert found[1] == ["No Mr , here .", "MR. X of Acme Inc."]
    assert found[2] == found[3] == [] and found[4] == found[5] == ["One .", "Two ."]
    repeated = spark.createDataFrame([(7, "Mr. A. Yes."), (7, "Mr. A. Yes."), (None, "Mr. A. Yes.")], "index INT, text STRING")
    assert sorted((r["index"] or 0, r.pos, r.sentence) for r in prepare.split_sentences(repeated, held).collect()) == [
        (i, pos, s) for i in (0, 7) for pos, s in ((0, "Mr. A ."), (1, "Yes .")) for _ in range(1 + (i == 7))
    ]


@pytest.mark.parametrize("text", ["No abbreviations here. At all? Yes!", "a\n b\t\tc...", "   ", "Really?! Yes (so it is.) Next."])
def test_no_abbreviations_change_nothing(spark, text):
    none = spark.createDataFrame([], "word STRING")
    other = spark.createDataFrame([("zz",)], "word STRING")
    for held in (none, other):
        rows = prepare.split_sentences(articles(spark, text), held).collect()
        assert [r.sentence for r in sorted(rows, key=lambda r: r.pos)] == split(spark, text)


def brute_force_abbreviations(texts):
    """The published likelihood ratio, word by word."""
    n, stops = Counter(), Counter()
    for text in texts:
        for w in text.split():
            if m := re.fullmatch(r"[(\"\[']*([A-Za-z]+(?:[.'-][A-Za-z]+)*)(\.?)[,;:)\]\"']*", w):
                n[m[1].lower()] += 1
                stops[m[1].lower()] += m[2] == "."
    share, scores = stops.total() / n.total(), {}
    for word, k in stops.items():
        if k:
            rest, letters = n[word] - k, len(word.replace(".", ""))
            chance = k * math.log(share) + (rest * math.log(1 - share) if rest else 0)
            own = k * math.log(0.99) + rest * math.log(0.01)
            score = -2 * (chance - own) * math.exp(-letters) * (word.count(".") + 1) * letters ** float(-rest)
            if score >= 0.3:
                scores[word] = (n[word], k, pytest.approx(score))
    return scores


def test_abbreviations_are_learned(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("talk", "sell", "rise", "walk") for b in ("ing", "er", "ed", "s")]
    sentence = lambda: " ".join(rng.choices(words, k=6)).capitalize() + "."
    texts = [f"Mr. Smith said. {sentence()} In the U.S. they (Acme Inc.) {sentence()} {sentence()} Said he, smith." for _ in range(60)]
    got = {r.word: (r.n, r.n_stops, r.score) for r in prepare.learn_abbreviations(articles(spark, *texts, None, "")).collect()}
    assert got == brute_force_abbreviations(texts) and set(got) == {"mr", "inc", "u.s"}
    assert prepare.learn_abbreviations(articles(spark, "").limit(0)).collect() == []
    assert prepare.learn_abbreviations(articles(spark, "no stop", "All. Stop. Here.")).where("score IS NULL OR isnan(score)").collect() == []


@pytest.mark.parametrize(
    "text,expected",
    [
        ("One two. Three, four? Five", ["One two .", "Three , four ?", "Five"]),
        ("Really?! Yes (so it is.) Next.", ["Really ? !", "Yes ( so it is . )", "Next ."]),
        ("It cost 3.14, or 1,000: see a.b", ["It cost 3.14 , or 1,000 : see a.b"]),
        ("a\n b\t\tc...", ["a b c ..."]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(spark, text, expected):
    assert split(spark, text) == expected


def test_newline_marks(spark):
    df = spark.createDataFrame([(1, "a\\nb\\\\n")], "index INT, text STRING")
    assert prepare.clean_newlines(df).first().text == "a b\\ "


def brute_force_tag(sentence, names):
    words, out, i = sentence.split(" "), [], 0
    longest = max((len(n.split(" ")) for n in names), default=0)
    while i < len(words):
        for k in range(min(longest, len(words) - i), 0, -1):
            gram = " ".join(words[i : i + k])
            if gram in names:
                out.append(f"<{names[gram]}>{gram}</{names[gram]}>")
                i += k
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def test_longest_names_first(spark, sentences):
    names = {"New York": "LOCATION", "New York Times": "ORGANIZATION", "York": "PERSON", "a": "LOCATION", "b a b": "PERSON"}
    gazetteer = spark.createDataFrame([*names.items(), ("York", "ZZZ")], "name STRING, tag STRING")
    rng = random.Random(8)
    texts = ["New York Times of New York", "York New York", "no name", ""]
    texts += [" ".join(rng.choice(["a", "b", "New", "York", "Times"]) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts += texts[:5]
    got = {r.sentence_id: r.sentence for r in prepare.tag_entities(sentences(*texts), gazetteer).collect()}
    assert got == {f"s{i:04d}": brute_force_tag(t, names) for i, t in enumerate(texts)}


def test_empty_gazetteer(spark, sentences):
    nothing = spark.createDataFrame([], "name STRING, tag STRING")
    assert prepare.tag_entities(sentences("a b"), nothing).first().sentence == "a b"


def test_own_model(sentences):
    def load():
        return lambda s: s.replace("Acme", "<ORGANIZATION>Acme</ORGANIZATION>")

    tagged = prepare.tag_with_model(sentences("Acme fell", "rain"), load).collect()
    assert sorted(r.sentence for r in tagged) == ["<ORGANIZATION>Acme</ORGANIZATION> fell", "rain"]


def test_words_take_the_lexicon_tag(spark, sentences):
    lexicon = spark.createDataFrame([("the", "DT")], "word STRING, tag STRING")
    rows = prepare.tag_words(sentences("the cat the"), lexicon).collect()
    assert sorted((r.pos, r.word, r.tag) for r in rows) == [(0, "the", "DT"), (1, "cat", "NN"), (2, "the", "DT")]


def test_whole_preparation(spark):
    line = "7\tx\ty\tz\tAcme fell.\\nRome saw Acme rise."
    articles = parse_articles(spark.createDataFrame([(line,)], "line STRING"))
    gazetteer = spark.createDataFrame([("Acme", "ORGANIZATION"), ("Rome", "LOCATION")], "name STRING, tag STRING")
    rows = prepare.prepare_corpus(articles, gazetteer).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [
        (7, 0, "<ORGANIZATION>Acme</ORGANIZATION> fell ."),
        (7, 1, "<LOCATION>Rome</LOCATION> saw <ORGANIZATION>Acme</ORGANIZATION> rise ."),
    ]


def test_rows_without_a_sentence_stay(spark):
    from pairloom.operators.prepare import tag_entities

    rows = spark.createDataFrame([("a", None), ("b", "Acme here")], "sentence_id STRING, sentence STRING")
    names = spark.createDataFrame([("Acme", "ORGANIZATION")], "name STRING, tag STRING")
    got = dict(tuple(r) for r in tag_entities(rows, names).collect())
    assert got == {"a": None, "b": "<ORGANIZATION>Acme</ORGANIZATION> here"}


def test_held_and_joined_dictionaries_agree(spark):
    """Names of one to three words that overlap, blanks, empty and null sentences, repeated rows."""
    chance = random.Random(3)
    words = ["a", "b", "c", "d", "", "é", "a.b"]
    texts = [" ".join(chance.choice(words) for _ in range(chance.randint(0, 9))) for _ in range(200)] + [None, "", " ", "a b c a b"]
    rows = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts * 2)], "id INT, sentence STRING")
    names = [("a", "X"), ("a", "W"), ("a b", "Y"), ("b c a", "Z"), ("c", "X"), ("é d", "Y"), ("", "E"), (None, "N"), ("d", None)]
    gazetteer = spark.createDataFrame(names, "name STRING, tag STRING")
    held = prepare.tag_entities(rows, gazetteer)
    joined = prepare._tag_by_join(rows, gazetteer.groupBy("name").agg(F.min("tag").alias("tag")))
    assert held.schema == rows.schema
    assert sorted(map(str, held.collect())) == sorted(map(str, joined.collect()))


def test_rows_stay_where_they_are(spark, sentences):
    """With a dictionary that a task can hold nothing is shuffled; every word run of every sentence was before."""
    gazetteer = spark.createDataFrame([("a b", "X")], "name STRING, tag STRING")
    found = prepare.tag_entities(sentences("a b c"), gazetteer)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.sentence for r in found.collect()] == ["<X>a b</X> c"]


def test_folded_words_take_the_same_tags(spark, monkeypatch):
    """A row for each id, with the tags of the row for each word, also where most of the lexicon is looked up by a join."""
    rows = [("a", "the cat the"), ("a", "a dog  é"), ("a", "a dog  é"), ("b", "the cat the"), (None, "dog"), ("c", None), ("d", "")]
    asked = spark.createDataFrame(rows, "sentence_id STRING, sentence STRING")
    entries = [("the", "DT", 5), ("dog", "VB", 2), ("dog", "NNP", 2), ("cat", None, 4), ("a", "NN", 1), ("", "E", 1), (None, "N", 9), ("é", "X", 1)]
    lexicon = spark.createDataFrame(entries, "word STRING, tag STRING, n INT")
    expected = {}
    for r in prepare.tag_words(asked, lexicon, "??").collect():
        expected.setdefault(r.sentence_id, []).append((r.pos, r.word, r.tag))
    for held in (prepare.HELD_NAMES, 2, 0):
        monkeypatch.setattr(prepare, "HELD_NAMES", held)
        for entries in (lexicon, lexicon.drop("n")):
            got = prepare.tag_words(asked, entries, "??", folded=True).collect()
            assert sorted(map(str, (r.sentence_id for r in got))) == ["None", "a", "b", "d"]
            found = {r.sentence_id: sorted((i, w, t) for x in r.tagged for i, (w, t) in enumerate(zip(x.words, x.tags, strict=True))) for r in got}
            assert found == {k: sorted(v) for k, v in expected.items()}
    nothing = prepare.tag_words(asked, lexicon.limit(0), "??", folded=True).collect()
    assert {t for r in nothing for x in r.tagged for t in x.tags} == {"??"}


def test_words_are_no_rows_of_a_shuffle(spark):
    """Sentences meet as plain text and words stay in them; each word was a row of two shuffles before."""
    plan = queries.tag_words(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0] and "Generate posexplode(split(sentence" not in plan


def test_articles_stay_where_they_are(spark):
    """With abbreviations that a task can hold nothing is shuffled; each article was, and a row for each of its words before a full stop."""
    held = spark.createDataFrame([("mr",)], "word STRING")
    found = prepare.split_sentences(articles(spark, "Mr. X fell. Mr. Y rose."), held)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.pos, r.sentence) for r in found.collect()] == [(0, "Mr. X fell ."), (1, "Mr. Y rose .")]


def odd_texts():
    chance = random.Random(11)
    pieces = ["Mr.", "(Mr.)", "U.S.", "inc.,", "a", "...", "?!", ".)", "]", "x.y", "é.", "Mr. ", "Dr.\u0085", "Mr.\u2028", "3.14", "", ":", '"Mr."', "o'b.", "Mr..", "\u0001", "\u0002.", ";"]
    ends = [" ", "  ", "\n", "\t ", "\r\n", "\x0b", " ", "\f"]
    return [" ".join(["Mr.", "X", "fell."]), "", " ", None] + ["".join(chance.choice(pieces) + chance.choice(ends) for _ in range(chance.randint(1, 14))) for _ in range(300)]


def test_held_and_joined_abbreviations_agree(spark):
    """Odd white space, line ends, marks and control characters, null numbers and repeated rows."""
    texts = odd_texts()
    rows = spark.createDataFrame([(i % 9 or None, t) for i, t in enumerate(texts * 2)], "index BIGINT, text STRING")
    for words in (["mr", "u.s", "inc", "o'b", "mr", None], ["zz"]):
        held = spark.createDataFrame([(w,) for w in words], "word STRING")
        got, expected = prepare.split_sentences(rows, held), prepare._split_by_join(rows, held)
        assert got.dtypes == expected.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_words_of_a_batch_are_those_of_spark(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING")
    words = exploded(rows, [], spaced_words("text"), "w").select(bare(F.col("w")).alias("word"), with_full_stop(F.col("w")).cast("int").alias("stop"))
    expected = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.sum("stop").alias("stops")).collect()
    assert count_words(pa.array([t for t in texts if t is not None])) == {r.word: [r.n, r.stops] for r in expected}
