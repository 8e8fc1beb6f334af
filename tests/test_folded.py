from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom import Params
from pairloom.operators import folded, score
from pairloom.operators.folded import fold_matches
from pairloom.operators.match import match_contexts, pattern_index
from pairloom.operators.segments import CONTEXT_KEY
from pairloom.plans import Round, bootstrap, prepare_mentions
from pairloom.staging import stage
from test_cluster import random_patterns
from test_match import frame


def named(rng, n):
    """Random contexts, some of which hold a name that few others hold."""
    out = []
    for i, (p, _) in enumerate(random_patterns(rng, n, "abcdef")):
        tag, *parts = p
        for part in rng.sample(parts, 2):
            if part and rng.random() < 0.7:
                part[f"name{rng.randrange(n // 3)}"] = rng.choice(list(part.values()))
        out.append((tag, *parts))
    return out


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("rare,plain,threshold", [(0, False, 0.5), (2, False, 0.5), (4, True, 0.6), (1000, False, 0.6)])
def test_folded_matches_equal_all_matches(spark, monkeypatch, rare, plain, threshold):
    """Supports and best patterns with all their bits, whatever is held to be rare; ids in no order of the classes."""
    monkeypatch.setattr(folded, "RARE", rare)
    rng = random.Random(rare)
    contexts = named(rng, 150)
    table = stage(frame(spark, contexts, "c1").select("*", (F.col("c1") * 2).alias("c2")), "contexts")
    patterns = stage(frame(spark, rng.sample(contexts, 90) + named(rng, 10), "pattern_id"), "patterns")
    params = Params(plain_cosine=plain)
    index = stage(pattern_index(patterns, threshold, params), "index")
    matches = stage(match_contexts(table, patterns, index, threshold, params), "matches")
    found = fold_matches(table, patterns, threshold, params)
    labels = stage(table.where("c1 % 3 > 0").select(*CONTEXT_KEY, (F.col("c1") % 5).alias("positives"), (F.col("c1") % 2).alias("negatives")), "labels")
    assert matches.count() > 50
    assert rows_of(score.pattern_support(found, labels)) == rows_of(score.pattern_support(matches, labels))
    assert rows_of(score.best_pattern(found)) == rows_of(score.best_pattern(matches))
    none = fold_matches(table, patterns.limit(0), threshold, params)
    assert score.pattern_support(none, labels).count() == 0 and score.best_pattern(none).count() == 0


def test_contexts_that_differ_by_a_name_are_not_paired(spark, sentences, seeds, monkeypatch):
    """Twice the organizations give twice the rows, not four times, and the relations of all pairs."""
    def rounds(n):
        # Each organization stands in its own context, so that all contexts are alike and match one another.
        texts = [f"Rivals <ORGANIZATION>o{i}</ORGANIZATION> and <ORGANIZATION>o{i}</ORGANIZATION> in <LOCATION>l{i % 3}</LOCATION> merged ." for i in range(n)] * 3
        params = Params(cluster_mode="exact")
        return Round(prepare_mentions(sentences(*texts)), stage(seeds(*((f"o{i}", f"l{i % 3}") for i in range(0, n, 2))), "seeds"), params)

    monkeypatch.setattr(bootstrap, "FOLD_BEYOND", 10)
    sizes = []
    for n in (40, 80):
        step = rounds(n)
        sizes.append(sum(t.count() for t in (step.folded.members, step.folded.patterns, step.folded.pairs, step.folded.singles)))
        assert rows_of(step.support) == rows_of(score.pattern_support(step.matches, step.labels))
        assert rows_of(step.best) == rows_of(score.best_pattern(step.matches))
        assert step.matches.count() >= n * n // 2
    assert sizes[1] <= 2.2 * sizes[0]
    assert rows_of(step.merged) == [(f"l{i % 3}", f"o{i}") for i in sorted(range(80), key=lambda i: (f"l{i % 3}", f"o{i}"))]
