"""The jobs from files to files."""

from __future__ import annotations

import pytest

from pairloom import Params
from pairloom.plans import article_statistics, extract_relations, tag_articles, tag_in_context, tag_parts_of_speech, word_statistics
from test_bootstrap import SEEDS, TEXTS


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "one.txt").write_text("\n".join(TEXTS[:6]) + "\n")
    (tmp_path / "two.txt").write_text("\n".join(TEXTS[6:]) + "\nno entity here\n")
    (tmp_path / "seeds.tsv").write_text("".join(f"{o}\t{l}\tmore\n" for o, l in SEEDS))
    return tmp_path


def test_extraction_from_tagged_files(spark, files):
    out = str(files / "out")
    inputs = [str(files / "one.txt"), str(files / "two.txt")]
    extraction = extract_relations(spark, inputs, str(files / "seeds.tsv"), out, Params(iterations=2))
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["(Acme,Rome)", "(Bolt,Oslo)", "(Cato,Lima)"]
    assert extraction.metrics.count() == 2


def plain(text):
    for tag in ("ORGANIZATION", "LOCATION"):
        text = text.replace(f"<{tag}>", "").replace(f"</{tag}>", "")
    return text


def test_extraction_from_articles_equals_that_from_tagged_sentences(spark, files):
    (files / "articles.tsv").write_text("".join(f"{i}\t\t\t\t{plain(t)} .\n" for i, t in enumerate(TEXTS)))
    names = [(n, "ORGANIZATION") for n in ("Acme", "Bolt", "Cato", "Dune")]
    names += [(n, "LOCATION") for n in ("Rome", "Oslo", "Lima", "Bern")]
    gazetteer = spark.createDataFrame(names, "name STRING, tag STRING")
    out = str(files / "out")
    extract_relations(spark, str(files / "articles.tsv"), str(files / "seeds.tsv"), out, gazetteer=gazetteer)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["(Acme,Rome)", "(Bolt,Oslo)", "(Cato,Lima)"]
    tag_articles(spark, str(files / "articles.tsv"), gazetteer, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == sorted(t + " ." for t in TEXTS)


def test_articles_with_abbreviations(spark, files):
    """An abbreviation between two names no longer separates them."""
    rows = [f"Shares of Acme Inc. of Rome rose {w} in trade." for w in ("more", "less", "twice", "here", "there")] * 4
    rows += ["In trade, shares rose.", "Rose, here and there."] * 4
    (files / "articles.tsv").write_text("".join(f"{i}\t\t\t\t{t}\n" for i, t in enumerate(rows)))
    gazetteer = spark.createDataFrame([("Acme", "ORGANIZATION"), ("Rome", "LOCATION")], "name STRING, tag STRING")
    found = []
    for learned in (False, True):
        tag_articles(spark, str(files / "articles.tsv"), gazetteer, str(files / "out"), abbreviations=learned)
        found.append({r.value for r in spark.read.text(str(files / "out")).collect()})
    assert "Shares of <ORGANIZATION>Acme</ORGANIZATION> Inc ." in found[0]
    assert "Shares of <ORGANIZATION>Acme</ORGANIZATION> Inc. of <LOCATION>Rome</LOCATION> rose more in trade ." in found[1]
    assert "In trade , shares rose ." in found[0] & found[1]


def test_word_statistics(spark, files):
    (files / "tagged.txt").write_text("a_X a_Y b_X\nb_X\n")
    best, most = str(files / "besttag"), str(files / "mosttags")
    top = word_statistics(spark, str(files / "tagged.txt"), best, most, k=1)
    assert [tuple(r) for r in top.collect()] == [("a", 2)]
    assert [r.value for r in spark.read.text(best).collect()] == ["(a,X,1)", "(a,Y,1)", "(b,X,2)"]
    assert sorted(r.value for r in spark.read.text(most).collect()) == ["(a,2)", "(b,1)"]


def test_parts_of_speech(spark, files):
    (files / "articles.tsv").write_text("3\t\t\t\tThe cat. A dog\n")
    lexicon = spark.createDataFrame([("The", "DT"), (".", ".")], "word STRING, tag STRING")
    out = str(files / "pos")
    tag_parts_of_speech(spark, str(files / "articles.tsv"), lexicon, out)
    rows = spark.read.parquet(out).orderBy("index", "sentence", "pos").collect()
    assert [tuple(r) for r in rows] == [
        (3, 0, 0, "The", "DT"), (3, 0, 1, "cat", "NN"), (3, 0, 2, ".", "."), (3, 1, 0, "A", "NN"), (3, 1, 1, "dog", "NN"),
    ]


def test_statistics_from_articles(spark, files):
    (files / "articles.tsv").write_text("3\t\t\t\tThe cat. A cat\nno article\n")
    lexicon = spark.createDataFrame([("The", "DT"), (".", "P")], "word STRING, tag STRING")
    best, most = str(files / "besttag"), str(files / "mosttags")
    top = article_statistics(spark, str(files / "articles.tsv"), lexicon, best, most, k=2)
    assert [tuple(r) for r in top.collect()] == [(".", 1), ("A", 1)]
    assert [r.value for r in spark.read.text(best).collect()] == ["(.,P,1)", "(A,NN,1)", "(The,DT,1)", "(cat,NN,2)"]
    assert sorted(r.value for r in spark.read.text(most).collect()) == ["(.,1)", "(A,1)", "(The,1)", "(cat,1)"]
    assert [r.value for r in spark.read.text(best + "-rejected").collect()] == ["no article"]


def test_tags_in_context_from_articles(spark, files):
    (files / "tagged.txt").write_text("the_DT rose_NN fell_VBD ._.\nprices_NNS rose_VBD ._.\n")
    (files / "articles.tsv").write_text("3\t\t\t\tThe prices rose. the rose fell.\n")
    out = str(files / "out")
    tag_in_context(spark, str(files / "articles.tsv"), str(files / "tagged.txt"), out)
    rows = spark.read.parquet(out).orderBy("sentence", "pos").collect()
    assert [(r["index"], r.sentence, r.word, r.tag) for r in rows][1:] == [
        (3, 0, "prices", "NNS"), (3, 0, "rose", "VBD"), (3, 0, ".", "."),
        (3, 1, "the", "DT"), (3, 1, "rose", "NN"), (3, 1, "fell", "VBD"), (3, 1, ".", "."),
    ]
