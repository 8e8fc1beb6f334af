"""Substring dedup, Merkle manifest and spelling variants against brute force, with the odd rows each has to take."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import merkle, spelling, substring

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Columns whose names the operators use inside.
EXTRA = "key LONG, part INT, item LONG, word STRING, n INT, rank INT, owner LONG, block INT"


def table(spark, rows, schema):
    """Rows with further columns of clashing names."""
    return spark.createDataFrame(rows, schema).select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")))


def kept_words(rows, window=13):
    """(words, kept words) of each row, window by window."""
    first = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - window + 1):
            if key is not None:
                first[tuple(w[i : i + window])] = min(first.get(tuple(w[i : i + window]), key), key)
    out = []
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "é", "Wort", "the", "of"]) + str(rng.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    shared, short, border = text(40), text(12), text(13)
    rows = [(key, " ".join(text(rng.randrange(60)) + shared[rng.randrange(15) :] + text(9) + short + text(5) + border * (key % 3) + text(rng.randrange(8)))) for key in range(60)]
    base = text(80)
    for key in range(60, 90):  # near copies
        copy = list(base)
        copy[rng.randrange(80)] = word()
        rows.append((key, "\n".join(copy)))
    rows += [(90 + i, " ".join(shared + border)) for i in range(20)]  # copies
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, " ".join(border)), (204, " ".join(border[:12])), (None, " ".join(shared)), (None, " ".join(shared))]
    rows += [(7, " ".join(shared)), (7, " ".join(shared)), (7, " ".join(base)), (205, " ".join(["x"] * 500)), (206, " ".join(["x"] * 14)), (-3, " ".join(border))]
    rows.append((207, " ".join(text(30)) + " " + " ".join(text(30_000) + shared)))  # very long
    return rows


@pytest.mark.parametrize("gathered", [1 << 20, 50])
def test_substring_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(substring, "GATHERED", gathered)
    rows = passages()
    found = substring.without_repeats(table(spark, rows, "doc_id LONG, text STRING").repartition(5)).collect()
    assert sorted(((r["key"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == kept_words(rows)
    for r in found:
        spans = [(x["start"], x["start"] + x["length"]) for x in r["repeats"] or ()]
        assert all(b - a >= 13 for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_substring_empty(spark):
    assert substring.without_repeats(table(spark, [], "doc_id LONG, text STRING")).collect() == []
    assert substring.without_repeats(table(spark, [(1, None), (None, None)], "doc_id LONG, text STRING")).count() == 2


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 60, dtype=np.uint64)
    other = [np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), shared, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for n in (0, 1, 17)]
    seen = []
    for h in other:
        seed = substring.grams(h, substring.SEED)
        place, start, n = substring.anchors(seed, np.array([0, len(h)]))
        assert n.sum() == len(h) - 12 and (place >= start + n - 1).all() and (place <= start + 8).all()
        at = len(h) - 80
        seen.append({int(s + i - at): int(p - at) for p, s, k in zip(place, start, n, strict=True) for i in range(k) if at <= s + i <= at + 47})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 48


def tree(nodes):
    """All levels of a tree of WIDTH children."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha256("".join(found[-1][i : i + 16]).encode()).hexdigest() for i in range(0, len(found[-1]), 16)])
    return found


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 16
        out += [x for j, x in enumerate(level[start : start + 16]) if start + j != i]
        i //= 16
    return out


def leaf(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def test_merkle_brute_force(spark):
    rng = random.Random(2)
    sizes = {None: 3, "a": 5000, "é": 17, "B": 1, "z": 256, "zz": 257, "": 16}
    sizes |= {f"s{i:03d}": 1 + i % 3 for i in range(40)}
    rows, key = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            key += rng.randrange(1, 4)
            rows.append((key, source, rng.choice(["de", None]), rng.choice([None, 5]), rng.choice(["Text", "", None, "é" * 9, "x Y"])))
    rows += [rows[0], rows[0], (None, "a", None, None, None), (None, "a", None, None, "u"), (4, "a", "en", 1, "L" * 300_000)]
    rng.shuffle(rows)
    docs = table(spark, rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = F.when(F.col("doc_id") % 7 == 0, merkle.digest(*(F.lower("text") if c == "text" else F.col(c) for c in fields)))
    found = merkle.manifest(docs.repartition(6), fields, group_col="source", id_col="doc_id", shown=shown).collect()

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    expected = []
    for i, s in enumerate(order):
        for j, (given, k, digest) in enumerate(sorted(groups[s])):
            expected.append((k if given else None, digest, trees[s][-1][0], top[-1][0], proof(trees[s], j) + proof(top, i)))
    assert sorted(((r["key"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in found), key=repr) == sorted(expected, key=repr)
    changed = {r[0] for r in rows if r[0] is not None and r[0] % 7 == 0 and r[4] is not None and r[4].lower() != r[4]}
    assert changed and all((r["folded_root"] != r["root"]) == (r["key"] in changed) for r in found if r["key"] != 4)
    assert all(merkle.fold(r["leaf"], r["siblings"], r["places"], r["widths"]) == r["root"] for r in found)


@pytest.mark.parametrize("rows", [[], [(1, "a", "x")], [(None, None, None)], [(1, "a", "x"), (1, "a", "x")]])
def test_merkle_small(spark, rows):
    docs = table(spark, rows, "doc_id LONG, source STRING, text STRING")
    found = merkle.manifest(docs, ["doc_id", "source", "text"], group_col="source", id_col="doc_id").collect()
    assert len(found) == len(rows)
    nodes = [leaf(r) for r in rows]
    assert all(r["root"] == r["folded_root"] == tree(nodes)[-1][0] for r in found)


def variants(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(beside[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_spelling_brute_force(spark):
    rng = random.Random(9)
    stems = ["Eléphant", "colourful", "separate", "aaaaaaaa", "banananan", "ÿÿÿÿÿÿÿ", "maximum", "strasseÀ", "immediately"]
    rows = []
    for key in range(3000):
        out = []
        for _ in range(3):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            if rng.random() < 0.05:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice("aeéxZ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéxZ") + w[i + 1 :]])
            if rng.random() < 0.01:
                w = w[1:] + "xx"
            out.append(w)
        rows.append((key, "-".join(out) + "œuvreuse 12"))
    # A chain: each word ten times as frequent as the next.
    rows += [(5000 + i, " ".join(["chainsaw"] * 1)) for i in range(2100)] + [(9000 + i, "chainsew") for i in range(205)] + [(9500 + i, "chainsewn") for i in range(12)]
    rows += [(None, "separate Separate"), (None, None), (1, ""), (2, "x" * 100_000), (3, "x" * 100_000), (4, "x" * 99_999), (5, "x" * 99_999)]
    rows += [(6, "twinwordsa twinwordsa")] * 2
    found = spelling.spelling_variants(table(spark, rows, "doc_id LONG, text STRING")).collect()
    expected = variants(rows)
    assert sorted((tuple(r) for r in found), key=repr) == expected
    assert any(form is not None and root != form for _, form, root, *_ in expected)


def test_spelling_empty(spark):
    assert spelling.spelling_variants(table(spark, [], "doc_id LONG, text STRING")).collect() == []
    assert spelling.spelling_variants(table(spark, [(1, "short words only")], "doc_id LONG, text STRING")).collect() == []


def test_slices_without_a_key_send_nothing(spark):
    """Null keys are left out slice by slice: one of them is a slice of its own, longer than SLICE_BYTES."""
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, 0, "x " * (3 << 20)), (1, 0, text), (2, 0, text)], "doc long, part int, text string").coalesce(1)
    assert sorted({r.doc for r in substring.seeds(docs).collect()}) == [1, 2]


def test_a_task_of_seeds_holds_arrays_of_few_texts():
    """The hashes of a batch's words are never in memory together, nor those of a large part of it."""

    class Rows:
        def mapInArrow(self, run, _):
            return run

    chance = np.random.default_rng(5)
    texts = [" ".join(map(str, chance.integers(0, 10**6, 2000))) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([0] * 600, pa.int32()), pa.array(texts)], ["doc", "part", "text"])
    run = substring.seeds(Rows())
    list(run(iter([batch.slice(0, 20)])))  # tables that are kept
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows > 200_000
    assert peak < 35e6
