from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom import Params
from pairloom.operators.cutting import cut_sentences
from pairloom.operators.segments import context_windows, sorted_windows, window_lists

ODD = [
    None, "", " ", "no tags", "<A></B>x</C>", "<ORGANIZATION></ORGANIZATION> <LOCATION></LOCATION>",
    "a <ORGANIZATION>Big Corp</ORGANIZATION>x  of <LOCATION>U S</LOCATION> .", "<LOCATION>L</LOCATION><ORGANIZATION>O</ORGANIZATION>",
    "<ORGANIZATION>\u0001A\u0002</LOCATION> near <LOCATION>B</LOCATION>", "ORGANIZATION\u0002x <ORGANIZATION>y</ORGANIZATION> <LOCATION>B</LOCATION>",
    "<ORGANIZATION>A</LOCATION> in <LOCATION>B</ORGANIZATION> of <ORGANIZATION>A</ORGANIZATION>",
    "<LOCATION>x <ORGANIZATION>y</LOCATION> z</ORGANIZATION> <ORGANIZATION>y</ORGANIZATION>",
    "<ORGANIZATION>two\nlines</ORGANIZATION> in <LOCATION>B</LOCATION> <ORGANIZATION>c d</ORGANIZATION> <ORGANIZATION>e\rf</ORGANIZATION> <ORGANIZATION>e\u2028f</ORGANIZATION> <ORGANIZATION>g</ORGANIZATION>",
    "b a é \U0001f600 ￮ <ORGANIZATION>o</ORGANIZATION> a b a <LOCATION>É</LOCATION> z \t y  x w \U0001f600 v",
]


def random_text(rng):
    mark = lambda: rng.choice(["<ORGANIZATION>", "</ORGANIZATION>", "<LOCATION>", "</LOCATION>"])
    whole = lambda: "<{0}>{1}</{0}>".format(rng.choice(["ORGANIZATION", "LOCATION", "PERSON"]), rng.choice(["A", "B b", "C\u0001"]))
    return rng.choice([" ", ""]).join(rng.choice([whole, whole, mark, lambda: rng.choice("abc "), lambda: "d e "])() for _ in range(rng.randrange(25)))


@pytest.mark.parametrize("params", [Params(), Params(window_size=0, max_distance=1), Params(window_size=2, max_distance=30, entity_tags=("LOCATION", "PERSON"))])
def test_batches_are_cut_like_rows(spark, params):
    rng = random.Random(params.window_size)
    texts = ODD + [random_text(rng) for _ in range(400)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sentence_id STRING, sentence STRING")
    whole = context_windows(df, params).select("org", "loc", "left_tag", *(F.sort_array(w).alias(w) for w in ("lw", "mw", "rw")), "occurrences")
    found = window_lists(sorted_windows(df, params))
    got, expected = (sorted(map(str, x.select("org", "loc", "left_tag", "lw", "mw", "rw", "occurrences").collect())) for x in (found, whole))
    assert got == expected and len(got) > 100


def test_a_batch_is_cut_at_once():
    """Well under the time that expressions take for a row (some fifty microseconds)."""
    texts = [f"Yesterday <ORGANIZATION>Supplier {i}</ORGANIZATION> shipped bolts to <LOCATION>NATION_{i % 25}</LOCATION> by rail ." for i in range(10_000)]
    batch = pa.array(texts)
    spent = []
    for _ in range(3):
        started = time.process_time()
        org, *_ = cut_sentences(batch, ("ORGANIZATION", "LOCATION"), 5, 5)
        spent.append(time.process_time() - started)
    assert len(org) == 10_000 and min(spent) < 0.3
    assert [len(x) for x in cut_sentences(batch.slice(0, 0), ("ORGANIZATION", "LOCATION"), 5, 5)] == [0] * 5
