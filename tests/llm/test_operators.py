"""Every operator against a brute-force version or an exact round trip, with nulls, empty tables, ties, repeats and odd columns."""

from __future__ import annotations

import inspect
import pickle
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import common, components, decontaminate, html, lines, mixing, neardup, preference, quality, tokens, topk, toxicity

DOCS = "doc_id long, text string, source string, size long, plan string, turn int"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "x", 1) for i, t, s in rows], DOCS).repartition(3)


def sentence(chance, n, words=400):
    return " ".join(f"w{chance.randrange(words)}" for _ in range(n))


def test_words_and_hashes_do_not_depend_on_place():
    texts = pa.array(["Ab  c d\n", None, "", "x AB c d"])
    data, at = common.text_bytes(texts)
    lowered = common.LOWERED[data]
    starts, ends, first = common.words(lowered, at)
    found = [bytes(lowered[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == ["ab", "c d", "x", "ab", "c d"] and first.tolist() == [0, 2, 2, 2, 5]
    h = common.word_hashes(lowered, starts, ends)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_mixing_reaches_targets_and_caps(spark):
    chance = random.Random(1)
    rows = [(i, sentence(chance, chance.randrange(1, 40)), f"s{chance.choice('aaaaaab')}") for i in range(300)]
    rows += [(900, None, None), (901, "", None), (902, "lone words here", "z"), (None, "no key", "sa")]
    docs = documents(spark, rows)
    mix, plan = mixing.mixture(docs)
    by_source = {r["source"]: r for r in plan.collect()}
    assert by_source[None]["target"] == 0 and by_source[None]["source_size"] == 0
    assert sum(r["target"] for r in by_source.values()) == pytest.approx(sum(r["source_size"] for r in by_source.values()))
    assert all(r["target"] <= 3 * r["source_size"] for r in by_source.values())
    got = mix.select("key", "source", "size", "copies").collect()
    assert len(got) == len(rows) and all(r["copies"] <= 3 for r in got)
    for source, r in by_source.items():
        taken = sum(x["size"] * x["copies"] for x in got if x["source"] == source)
        assert abs(taken - r["target"]) <= 40 + 0.02 * r["target"]
    again, _ = mixing.mixture(docs.repartition(5))
    key = lambda r: (str(r["key"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_preference_prefix_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (2, 0, "user", "alone"), (2, 0, "user", "alone"), (None, 0, "user", "x")]
    made = preference.segments(preference.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = sorted((r["pair_id"], r["part"], r["place"], r["content"][r["mask_start"] : r["mask_end"]]) for r in made.collect())
    assert got == [(0, "chosen", 1, "a<|end|>\n"), (0, "chosen", 2, ""), (0, "prompt", 0, ""), (0, "rejected", 1, "b<|end|>\n"), (1, "chosen", 0, ""), (1, "chosen", 1, "")]
    assert made.limit(0).count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return {i: (len(sets[i]), label[i]) for i in sets}, linked


def test_near_duplicates_equal_brute_force(spark):
    chance = random.Random(4)
    texts = {}
    passage = sentence(chance, 50)
    for base in range(12):
        words = sentence(chance, chance.choice([3, 6, 12, 40, 130, 300])).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(chance.randrange(0, max(2, len(copy) // 25))):
                copy[chance.randrange(len(copy))] = f"x{chance.randrange(1000)}"
            texts[len(texts)] = " ".join(copy)
    for _ in range(30):
        texts[len(texts)] = sentence(chance, 90) + " " + passage
    texts |= {500: None, 501: "", 502: " \t\n", 503: "One word", 504: "one WORD", 505: "a b c d", 506: "a b c d e f g", 507: "a b c d e f g h"}
    docs = documents(spark, [(i, t, None) for i, t in texts.items()])
    expected, linked = brute_components(texts)
    got = {r["key"]: (r["n"], r["component"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == expected
    described, pairs = neardup.similar_classes(docs)
    of = {r["key"]: r["class"] for r in described.collect()}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {tuple(sorted((of[i], of[j]))) for i, j in linked if of[i] != of[j]}
    kept = neardup.first_of_each(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole_holds_for_all_sizes():
    chance = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 7, 20, 31, 32, 33, 42, 64, 100, 128, 200, 400, 700, 1024, 1500, 3000]:
        s = np.unique(chance.integers(0, 2**64 - 1, n, dtype=np.uint64))
        for top, allowed in neardup.bands(n):
            assert len(neardup.sketch(s, top)) > allowed
        least = -(-3 * n // 4)
        for partner in {n, least, n * 4 // 3}:
            ours, theirs = (dict(neardup.bands(k)) for k in (n, partner))
            assert set(ours) & set(theirs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_site_lines(spark):
    rows = [(i, f"own {i}\nshared\n\nshared", "h") for i in range(12)] + [(20, "shared", "rare"), (21, None, None), (22, "", None), (23, "shared", "h")]
    docs = documents(spark, rows)
    made, dropped = lines.without_site_lines(docs, F.col("source"), ratio=0.5)
    got = {r["doc_id"]: (r["text"], r[dropped]) for r in made.collect()}
    assert got[0] == ("own 0\n", 2) and got[20] == ("shared", 0) and got[21] == (None, 0) and got[22] == ("", 0) and got[23] == ("", 1)
    assert set(made.columns) == {*docs.columns, dropped}


def test_decontamination_equals_brute_force(spark, monkeypatch):
    chance = random.Random(3)
    items = [(i, sentence(chance, chance.choice([4, 10, 25]), 30)) for i in range(20)] + [(90, None), (91, "--"), (92, "W1"), (None, sentence(chance, 12, 30))]
    texts = {i: sentence(chance, chance.randrange(60), 30) for i in range(60)} | {100: None, 101: "", 102: "A, b! " + items[3][1].upper() + " zz " + items[3][1]}
    docs = documents(spark, [(i, t, None) for i, t in texts.items()])
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = {}
    for i, t in texts.items():
        w, hit, ids = low(t), set(), set()
        for item, text in items:
            v = low(text)
            size = min(10, len(v))
            for k in range(len(v) - size + 1) if v else []:
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[k : k + size]:
                        hit |= set(range(p, p + size))
                        ids |= {str(item)} - {"None"}
        expected[i] = (len(w), len(hit), sorted(ids))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        rows, name = decontaminate.matched(docs, bench)
        got = {r["doc_id"]: (r[name]["n_words"], r[name]["n_hit"], sorted({m["item_id"] for m in r[name]["matches"]} - {None})) for r in rows.collect()}
        assert got == expected
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, (_, n, _) in expected.items() if not n}
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(texts)
    longest = max((m["length"] for r in rows.where("doc_id = 102").collect() for m in r[name]["matches"]), default=0)
    assert longest == len(low(items[3][1]))


def test_token_files_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    chance = random.Random(5)
    texts = {i: sentence(chance, chance.randrange(60)) for i in range(80)} | {100: None, 101: "", 102: " lead", 103: "trail ", 104: "two  spaces \n and more", 105: "it's <|endoftext|> it", 106: "w1 " * 900}
    docs = documents(spark, [(i, t, None) for i, t in texts.items()])
    files = tokens.write_sequences(docs, common.shared_folder(spark), tokenizer=path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2, length=64)
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    at, expected, stream = 0, [], []
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), tokens.crc32(np.array(ids, "<u4").tobytes())))
        at, stream = at + len(ids), stream + ids
    got = tokens.read_documents(files).select("key", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == expected
    rows = []
    for r in files.orderBy("part").collect():
        reader = tokens.open_sequences(r["file"])
        for i in range(r["n_sequences"]):
            ids, mask = tokens.sequence(reader, i)
            assert len(ids) == len(mask) == 64 and mask.dtype == bool
            assert not ids.flags.owndata  # a view of the file
            rows += ids[mask].tolist()
    assert rows == stream
    odd = documents(spark, [(5, "b", None), (None, "n", None), (5, "a", None), (None, None, None), (5, "b", None)])
    files = tokens.write_sequences(odd, common.shared_folder(spark), tokenizer=path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2, length=4)
    got = [(r["key"], r["start"], r["n_tokens"]) for r in tokens.read_documents(files).orderBy("start").collect()]
    assert got == [(None, 0, 1), (None, 1, 2), (5, 3, 2), (5, 5, 2), (5, 7, 2)] or got == [(None, 0, 2), (None, 2, 1), (5, 3, 2), (5, 5, 2), (5, 7, 2)]
    empty = tokens.write_sequences(docs.limit(0), common.shared_folder(spark), tokenizer=path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2)
    assert tokens.read_documents(empty).count() == 0


def test_new_words_are_encoded_together():
    from public_tokenizers import path

    encoder = tokens.PieceEncoder(path("byte_bpe_50k.json"))
    given = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    plain, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    many = " ".join(f"w{i} x{i}.\ny{i}" for i in range(1000))
    texts = [many, "", " ", "a ", "a b\t", "\t a", "it's <|endoftext|> a<|endoftext|> b", "\u00e9t\u00e9 \u4e2d\u00a0 x\u3000y \U0001f600 z", "end\n\n", many]
    ids, at = encoder.encode(texts, 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert len(given) < 600


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    chance = np.random.default_rng(2)
    vectors = [(i, (chance.normal(0, 1, 6) * chance.choice([0.1, 1, 3])).tolist()) for i in range(240)]
    vectors += [(300 + i, vectors[0][1]) for i in range(40)] + [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [0.0] * 6), (600, [1.0, 2.0])]
    got = topk.top_products(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if v and None not in v and np.isfinite(v).all()}
    expected = []
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_top_products_of_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    chance = np.random.default_rng(3)
    vectors = [(i, chance.normal(0, 1, 4).tolist()) for i in range(90)]
    repeated = [*vectors, vectors[50], vectors[50], vectors[7], (0, [-x for x in vectors[0][1]])]
    got = topk.top_products(spark.createDataFrame(repeated, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 50 == 0).collect()
    rows = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in repeated]
    expected = []
    for q, v in [rows[0], rows[50], rows[-1]]:
        best = sorted((-int(w @ v), i) for i, w in rows if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var a='<p>';</script></head><body>{body}</body></html>"


def test_main_texts(spark):
    rows = [(i, f"http://a.b/{i}", page(f"<nav>Home</nav><div class='ad'>buy {i}</div><article><h1>T{i}</h1><p>x<b>y</b>&amp; z{i}<br>q<p>next\n\n one<div class=comments>bad</div></article><footer>f</footer>")) for i in range(8)]
    rows += [(50, None, None), (51, "", ""), (52, "http://c/", "plain &lt;text&gt; <b>only"), (53, "http://d/", page("<main>m</main><aside>no</aside>"))]
    rows += [(100 + i, f"http://div.only/{i}", page(f"<div id=top><span>Logo</span></div><div id=story><p>Story {i} is long enough to be the text</p></div><div class=footer>x</div>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 xy& z3 q next one" and got[50] == "" and got[51] == "" and got[52] == "plain <text> only" and got[53] == "m"
    assert got[105] == "Story 5 is long enough to be the text" and len(got) == len(rows)


def test_markup_that_does_not_swallow_an_article():
    def text(body):
        found = html.Page(page(body))
        return found.text(found.own_slot())

    assert text("<article>a <svg class='i'/>b <svg><text>no</text></svg>c <math/>d</article>") == "a b c d"
    assert text("<article><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math> holds</p></article>") == "so x=1 holds"
    assert text("<form id=all><nav>n</nav><article>story<form>your name</form></article></form>") == "story"
    assert text("<form><nav>n</nav><div>a story in a form</div><footer>f</footer></form>") == "a story in a form"
    assert text("<div>a story of its own</div><form>your name</form>") == "a story of its own"


@pytest.mark.parametrize(
    "body,expected",
    [
        ("<article>a <b title='x>y'>b</b> <i class=\"open>c</i></article>", "a b c"),  # open quotes end at the next >
        ("<article>a < b <c", "a < b <c"),  # a tag without an end is text
        ("<article>a<!-- b > c", "a"),
        ("<article>a<script>b > c", "a"),
        ("<article>a<!x<p>b", "ab"),  # a declaration ends at the next >
        ("<article>a <nav><p>b<div>c</nav>d</article>e", "a d"),
        ("<article>&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65;</article>", "\ufffd A"),
    ],
)
def test_broken_markup(body, expected):
    found = html.Page(body)
    assert found.text(found.own_slot()) == expected


@pytest.mark.parametrize("piece", ["<a ", "<svg '", "<div>x ", '<a "> " ', "<a<b", "<!", "<!-", "<script", "<form>x", "<b>x</b>", '<div class="', "<p>x<p class='ad'", "</div"])
def test_long_broken_pages_are_read_in_one_pass(piece):
    """Ten times the page takes about ten times the time; a pass for each tag would take a hundred times."""

    def seconds(size):
        begin = time.process_time()
        found = html.Page("<article>" + piece * (size // len(piece)) + ">")
        found.occurrences()
        found.text(found.own_slot())
        return time.process_time() - begin

    assert seconds(1_000_000) < 40 * max(seconds(100_000), 0.02)


def test_pages_with_clashing_columns_and_no_pages(spark):
    columns = "page_id long, url string, html string, host string, slot string, fixed array<long>, of string, id int, text string"
    rows = [(i, f"http://a.b/{i}", page(f"<article>story {i}</article>"), "h", "s", [1], "o", 3, "t") for i in (1, 2, 2, None)]
    got = html.main_texts(spark.createDataFrame(rows, columns))
    assert got.columns == ["page_id", "url", "text"] and sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, "story None"), (1, "story 1"), (2, "story 2"), (2, "story 2")]
    assert html.main_texts(spark.createDataFrame([], columns)).collect() == []


def test_template_goes_before_own_article(spark):
    teasers = lambda i: "".join(f"<article><h3>Teaser {i} {k}</h3></article>" for k in range(1 + i % 3))
    rows = [(i, f"http://t.x/{i}", page(f"<main><article id=post-{i}><p>Send us a letter</p><p>Story {i} is long enough to be the text of a page, which is more than its teasers hold</p></article>{teasers(i)}</main>")) for i in range(12)]
    rows += [(50 + i, f"http://u.x/{i}", page(f"<main><article><p>Story {i} is long enough to be the text of a page</p></article>{teasers(i)}</main>")) for i in range(12)]
    rows += [(20, "http://u.x/list", page("<main>" + "".join(f"<article><p>Entry {k} of a list</p></article>" for k in range(6)) + "</main>"))]
    rows += [(30 + i, f"http://near.x/{i}", page(f"<div><p>All pages have this long text alike, but for a word</p><p>of number {i}</p></div>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is long enough to be the text of a page, which is more than its teasers hold" for i in range(12))
    assert all(got[50 + i] == f"Story {i} is long enough to be the text of a page" for i in range(12))
    assert got[20] == " ".join(f"Entry {k} of a list" for k in range(6))
    assert all(got[30 + i] == f"All pages have this long text alike, but for a word of number {i}" for i in range(8))


def test_copies_of_a_page_keep_their_text(spark):
    copy = "<div id=top>Logo</div><div id=story><p>One story</p><p>that ten pages</p><p>hold alike</p></div>"
    rows = [(i, f"http://div.only/{i}", page(copy)) for i in range(10)]
    rows += [(10, "http://div.only/10", page(copy.replace("ten", "eleven"))), (11, "http://div.only/11", page(copy.replace("One", "Another")))]
    rows += [(20 + i, f"http://ads.only/{i}", page(copy + f"<div class=ad>buy {i}</div>")) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith("One story that ten pages hold alike") for i in [*range(10), *range(20, 30)])
    stories = [(i, f"http://div.only/{i}", page(f"<div id=top>Logo</div><div id=story><p>Story {i} is long enough to be the text</p></div>")) for i in (*range(6), *[6] * 30)]
    got = {(r["page_id"], r["text"]) for r in html.main_texts(spark.createDataFrame(stories, "page_id long, url string, html string")).collect()}
    assert got == {(i, f"Story {i} is long enough to be the text") for i in range(7)}


def test_occurrence_sums_tell_vectors_apart():
    assert html.vector_sums(np.array([1, 0, 2])) != html.vector_sums(np.array([1, 2, 0])) and html.vector_sums(np.array([0, 0])) == (0, 0)


def test_network_gradients():
    chance = np.random.default_rng(0)
    network = toxicity.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, mask, y, w = chance.normal(0, 1, (5, 3, toxicity.INPUTS)), np.arange(5)[:, None] < np.array([5, 2, 0]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        kept = [network._direction(x[o] @ network.p[f"w_{d}"] + network.p[f"c_{d}"], mask[o], d, None)[o] for d, o in (("f", slice(None)), ("b", slice(None, None, -1)))]
        p = toxicity._sigmoid(network._pool(np.concatenate(kept, 2), mask)[2])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = network.step(x, mask, y, w)
    for name, value in network.p.items():
        at = tuple(0 for _ in value.shape)
        value[at] += 1e-3
        up = loss()
        value[at] -= 2e-3
        down = loss()
        value[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(np.asarray(grads[name])[at]), abs=2e-3)


def labelled(spark, bad):
    chance = random.Random(6)
    texts, labels = [], []
    for i in range(260):
        wrong = i % 3 == 0
        texts.append((i, bad(sentence(chance, 120), chance) if wrong else sentence(chance, 120) + ".", None))
        labels.append((i, int(not wrong), int(wrong)))
    texts += [(900, None, None), (901, "", None), (902, "x " * 30_000, None)]
    return documents(spark, texts), spark.createDataFrame([*labels, (903, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, lambda t, c: " ".join("scum" if c.random() < 0.03 else w for w in t.split()) + " scum")
    model = toxicity.fit_toxicity(docs, labels, common.fold(F.col("key"), 5) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(scores) == 263 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert scores[900] == scores[901] < 0.5
    assert toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_toxicity_learns_one_text_of_each_key(spark):
    docs, labels = labelled(spark, lambda t, c: t + " scum")
    few = docs.where("doc_id < 24")
    repeated = few.unionByName(few.where("doc_id < 3")).unionByName(few.where("doc_id < 3").withColumn("text", F.lit("~ later text")))
    models = [toxicity.fit_toxicity(d, labels, F.lit(True), per_label=20) for d in (few, repeated.repartition(2))]
    assert pickle.dumps(models[0].network.p) == pickle.dumps(models[1].network.p) and models[0].shift == models[1].shift
    assert inspect.signature(toxicity.fit_toxicity).parameters["per_label"].default == 2500


def test_quality_held_out(spark):
    docs, labels = labelled(spark, lambda t, c: t.upper().replace(" ", "!! | "))
    model = quality.fit_quality(docs, labels, common.fold(F.col("key"), 4) != 2)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert len(scores) == 263 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in range(260) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= 0.7) == (i % 3 != 0) for i in held) >= 0.95 * len(held)
    kept = quality.keep_quality(docs, model, 0.7)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    blank = quality.fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, blank).collect()} == {1.0}


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 2, 1, 4]), np.array([2.0, 2, 2, 4])).tolist() == [0, 0.75, 0.75, 1]
