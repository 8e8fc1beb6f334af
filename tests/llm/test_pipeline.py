"""The stages of the corpus pipeline against brute force on a small table with odd rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from pairloom.llm import neardup

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(rows):
    """Rows by what they reach through links, rows without words alone."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def corpus():
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base, other = text(80), text(60)
    near = [base.replace(base.split()[k], "new", 1) for k in (3, 40)]
    rows = [(k, text(rng.randrange(20, 60))) for k in range(30)]
    rows += [(50, base), (41, near[0]), (42, near[1]), (None, base), (None, near[0])]
    rows += [(60, other), (60, other), (61, other), (60, text(30)), (None, "alone in the world without a key"), (None, "alone in the world without a key")]
    rows += [(70, None), (70, ""), (None, None), (71, " \n"), (72, "two words"), (73, "two words")]
    return [(k, t, "en", f"src{i % 3}", len(t or "")) for i, (k, t) in enumerate(rows)]


@pytest.mark.parametrize("rows", [corpus(), corpus()[:30], [(k, "the same text", None, None, None) for k in (1, 1, 2, None, None)], []])
def test_one_row_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(r) for r in corpus_pipeline.deduplicated(spark, docs, "").collect()]
    label = groups(rows)
    expected = []
    for g in set(label):
        members = [r for r, x in zip(rows, label, strict=True) if x == g]
        expected.append(min((r[0] is None, r[0] or 0) for r in members))
    assert len(kept) == len(expected)
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(expected)
    assert all(r in rows for r in kept)
    left = groups(kept)
    assert len(set(left)) == len(left)


def test_links_of_rows_without_keys(spark):
    found = neardup.near_duplicates(spark.createDataFrame(corpus(), SCHEMA)).collect()
    assert all((r["group"] is None) == (r["n"] == 0) == (r["class"] is None) for r in found)
    assert {r["component"] for r in found if r["key"] in (41, 42, 50)} == {41}


def test_stages_of_the_whole_pipeline(spark, tmp_path):
    """Every stage on what the one before it kept: no rows from nowhere, columns of documents, and token files of all copies."""
    from conftest import TINY

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    before = {tuple(r) for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == columns, name
        path = str(tmp_path / name.replace(" ", "_").replace("/", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = [tuple(r) for r in docs.collect()]
        assert rows and set(rows) <= before, name
        if name == "n-gram Jaccard join":
            assert len(set(groups(rows))) == len(rows)
        before = set(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r[0] for r in rows)
    assert sorted(r["start"] for r in last)[0] == 0 and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
