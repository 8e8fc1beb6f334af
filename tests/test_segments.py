from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import model
from pairloom import Params
from pairloom.functions.tagged import bare_tokens_sql, bind, marked_sites_sql, marked_tokens_sql, sites_sql, tokens_sql
from pairloom.operators import segments

SEGMENT = "said <ORGANIZATION>Acme Corp</ORGANIZATION> , based in <LOCATION>New York</LOCATION> , reported earnings today"


def vec(rows):
    return {x["token"]: round(x["weight"], 9) for x in rows}


def rounded(v):
    return {t: round(w, 9) for t, w in v.items()}


def test_tokenizer_accepts_mismatched_and_glued_tags(sentences):
    text = (
        "Foo bar<ORGANIZATION>Goldman Sachs</ORGANIZATION>, is  in <LOCATION>New York</PERSON> x <b>y</b> a < z"
    )
    got = [tuple(t) for t in segments.tokenize(sentences(text)).first().tokens]
    plain = ["Foo", "bar", None, ",", "is", "in", None, "x", "<b>y</b>", "a", "<", "z"]
    expected = [(w, "") for w in plain]
    expected[2], expected[6] = ("Goldman Sachs", "ORGANIZATION"), ("New York", "LOCATION")
    assert got == expected


def test_segment_golden(sentences):
    row = segments.text_segments(sentences(SEGMENT)).first()
    assert (row.org, row.loc, row.left_tag, row.a, row.b) == ("Acme Corp", "New York", "ORGANIZATION", 1, 5)
    assert vec(row.lc) == {"said": 1.0}
    assert vec(row.mc) == rounded({",": 1 / 3, "based": 1 / 3, "in": 1 / 3})
    assert vec(row.rc) == {",": 0.25, "reported": 0.25, "earnings": 0.25, "today": 0.25}


def test_filter_is_a_substring_test(sentences):
    kept = segments.filter_by_tags(sentences("ORGANIZATION and LOCATION", "<ORGANIZATION>a</ORGANIZATION>"))
    assert [r.sentence for r in kept.collect()] == ["ORGANIZATION and LOCATION"]


def test_occurrences_weigh_raw_patterns(sentences, seeds):
    text = "x <ORGANIZATION>A</ORGANIZATION> q <ORGANIZATION>A</ORGANIZATION> in <LOCATION>R</LOCATION> ."
    mentioned = segments.mentions(sentences(text))
    assert mentioned.agg({"n": "sum"}).first()[0] == 2
    raw = segments.raw_patterns(mentioned, seeds(("A", "R")))
    assert raw.agg({"weight": "sum"}).first()[0] == 4
    twice = segments.raw_patterns(mentioned, seeds(("A", "R"), ("A", "R")))
    assert twice.agg({"weight": "sum"}).first()[0] == 8


def test_organization_read_only_by_the_tokenizer_has_no_raw_pattern(sentences, seeds):
    text = "x <ORGANIZATION>A</LOCATION> in <LOCATION>R</LOCATION> ."
    mentioned = segments.mentions(sentences(text))
    assert mentioned.count() == 1
    assert segments.raw_patterns(mentioned, seeds(("A", "R"))).count() == 0


def random_sentence(rng):
    words = ["a", "b", "c", ",", "in", "of"]
    out = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.random()
        if kind < 0.2:
            out.append(f"<ORGANIZATION>{rng.choice(['A', 'B B'])}</ORGANIZATION>")
        elif kind < 0.4:
            out.append(f"<LOCATION>{rng.choice(['R', 'S S'])}</LOCATION>")
        elif kind < 0.45:
            out.append("<PERSON>P</PERSON>")
        else:
            out.append(rng.choice(words))
    return rng.choice([" ", "  "]).join(out)


@pytest.mark.parametrize("window,distance", [(5, 5), (2, 3), (0, 1)])
def test_segments_equal_the_sequential_model(sentences, window, distance):
    rng = random.Random(3)
    texts = [random_sentence(rng) for _ in range(300)]
    params = Params(window_size=window, max_distance=distance)
    got = segments.text_segments(segments.filter_by_tags(sentences(*texts), params), params).collect()
    got = sorted((r.org, r.loc, r.left_tag, *(sorted(vec(v).items()) for v in (r.lc, r.mc, r.rc))) for r in got)
    expected = sorted(
        (o, l, tag, *(sorted(rounded(v).items()) for v in parts))
        for t in texts
        for o, l, tag, *parts in model.segments(t, window, distance)
    )
    assert got == expected


def test_mentions_count_every_segment_and_keys_are_unique(sentences):
    rng = random.Random(4)
    texts = [random_sentence(rng) for _ in range(300)]
    rows = segments.mentions(sentences(*texts)).collect()
    assert sum(r.n for r in rows) == sum(len(model.segments(t)) for t in texts)
    contexts = {(r.left_tag, tuple(r.lw), tuple(r.mw), tuple(r.rw)) for r in rows}
    assert len({(r.c1, r.c2) for r in rows}) == len({r.c1 for r in rows}) == len(contexts)


def test_raw_patterns_equal_the_sequential_model(sentences, seeds):
    rng = random.Random(5)
    texts = [random_sentence(rng) for _ in range(300)]
    pairs = [("A", "R"), ("B B", "R"), ("B B", "S S")]
    raw = segments.raw_patterns(segments.mentions(sentences(*texts)), seeds(*pairs)).collect()
    got = {(r.left_tag, *(tuple(sorted(vec(v).items())) for v in (r.lc, r.mc, r.rc))): r.weight for r in raw}
    expected: dict = {}
    for tag, *parts in model.raw_patterns(texts, pairs):
        key = (tag, *(tuple(sorted(rounded(v).items())) for v in parts))
        expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_one_tokenizer_per_row_and_no_python(sentences):
    plan = segments.text_segments(sentences(SEGMENT))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert "Python" not in plan


def test_marked_tokens_are_the_tagged_tokens(spark, sentences):
    """Tokens as marked strings give the texts and sites of the token structs."""
    df = sentences(
        "a <ORGANIZATION>Big Corp</ORGANIZATION>x  of <LOCATION>U S</LOCATION> .", "", " ", "no tags", "<A></B>x</C>",
        "<ORGANIZATION>\u0001A\u0002</LOCATION> near <LOCATION>B</LOCATION>", "ORGANIZATION\u0002x <ORGANIZATION>y</ORGANIZATION>",
    )
    for tag in ("ORGANIZATION", "LOCATION"):
        marked = F.expr(bind(marked_tokens_sql("sentence"), "t", f"named_struct('w', {bare_tokens_sql('t')}, 's', {marked_sites_sql('t', tag)})"))
        whole = F.expr(bind(tokens_sql("sentence"), "t", f"named_struct('w', t.text, 's', {sites_sql('t', tag)})"))
        rows = df.select(marked.alias("m"), whole.alias("t")).collect()
        assert [r.m for r in rows] == [r.t for r in rows] and any(r.m.s for r in rows)


def test_a_rendered_sentence_is_rendered_once(spark):
    """Testing for tags does not compute the text anew."""
    rendered = spark.range(20).select(F.expr("CAST(id AS STRING)").alias("sentence_id"), F.expr("concat(repeat('LOCATION ', CAST(id % 2 AS INT)), 'ORGANIZATION')").alias("sentence"))
    kept = segments.filter_by_tags(rendered)
    assert kept.columns == rendered.columns and kept.count() == 10
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("repeat(") == 1
    nothing = spark.createDataFrame([("a", None)], rendered.schema)
    assert segments.filter_by_tags(nothing).count() == 0
