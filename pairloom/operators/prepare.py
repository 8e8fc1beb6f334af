"""From articles to entity-tagged sentences and to tagged words."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.sentences import count_words, cut_sentences
from pairloom.functions.tagged import bare, bind, exploded, sentence_list, spaced_words, with_full_stop
from pairloom.operators.lookup import sentence_rows, split_words, with_answers
from pairloom.staging import stage

#: How often an abbreviation is before a full stop, and the least score of one.
OWN_STOP, LEAST_SCORE = 0.99, 0.3
#: A dictionary of up to so many names is known to every task; a larger one is joined.
HELD_NAMES = 100_000


def clean_newlines(articles: DataFrame) -> DataFrame:
    """Replace the two characters ``\\n`` in article texts by a space."""
    return articles.withColumn("text", F.replace("text", F.lit("\\n"), F.lit(" ")))


def learn_abbreviations(articles: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``(word, n, n_stops, score)``: words whose full stop is their own, learned from the articles alone.

    A word is scored by the likelihood ratio of "nearly always before a full
    stop" to "before one as often as any word", times e to the minus length,
    times one more than its inner full stops, over the length to the power of
    how often no full stop follows (unsupervised collocation, as published for
    sentence boundaries). Short words that are seen without a full stop hardly
    ever remain. Words are counted in each batch of articles; the shuffle
    carries a row for each distinct word of a batch at most, whatever the text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_words(batch.column("text"))
            n, n_stops = zip(*counts.values(), strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(n, pa.int64()), pa.array(n_stops, pa.int64())], ["word", "n", "n_stops"])

    words = _once(articles).select("text").mapInArrow(count, "word string, n long, n_stops long")
    # Written, since both the words and their share come from these counts, and the articles are read once for both.
    counts = stage(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_stops").alias("n_stops")), "word-stops")
    # One row.
    share = counts.agg((F.sum("n_stops") / F.sum("n")).alias("share"))
    k, rest = F.col("n_stops"), F.col("n") - F.col("n_stops")
    chance = k * F.ln("share") + F.when(rest == 0, 0.0).otherwise(rest * F.ln(1 - F.col("share")))
    own = k * math.log(OWN_STOP) + rest * math.log(1 - OWN_STOP)
    length = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - length
    score = -2 * (chance - own) * F.exp(-length) * (inner + 1) * F.pow(length.cast("double"), -rest)
    scored = counts.where(k > 0).join(F.broadcast(share)).select("word", "n", "n_stops", score.alias("score"))
    return scored.where(F.col("score") >= least)


def _once(articles: DataFrame) -> DataFrame:
    """The articles whose text is not null, as valid text. Exploding a list of one keeps the filter above the text, which is made once."""
    return articles.withColumn("text", F.explode_outer(F.array(F.make_valid_utf8("text")))).where(F.col("text").isNotNull())


def split_sentences(articles: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """``(index, text)`` to ``(index, pos, sentence)``, tokens joined by one space.

    With ``abbreviations`` (a column ``word``, as :func:`learn_abbreviations`
    gives them) their full stops end no sentence and stay with the word. Up to
    ``HELD_NAMES`` of them are known to every task, and articles stay where they
    are. Of more, each article's distinct words before a full stop are looked
    up, and the list of those found comes back by a 128-bit key of the article.
    """
    if abbreviations is None:
        return exploded(articles, ["index"], sentence_list("text"), "pos", "sentence")
    words = [r["word"] for r in abbreviations.where("word IS NOT NULL").select("word").distinct().limit(HELD_NAMES + 1).collect()]
    if len(words) > HELD_NAMES:
        return _split_by_join(articles, abbreviations)
    held = articles.sparkSession.sparkContext.broadcast(frozenset(words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, sentences = cut_sentences(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("index").take(pa.array(row)), pa.array(pos, pa.int32()), sentences], ["index", "pos", "sentence"])

    schema = T.StructType([articles.schema["index"], T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType())])
    return _once(articles).select("index", "text").mapInArrow(cut, schema)


def _split_by_join(articles: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """:func:`split_sentences` by joins, however many abbreviations there are."""
    identity = [x for c in ("index", "text") for x in (F.col(c).isNull(), F.col(c))]
    keyed = articles.select("index", "text", F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit("article"), *identity).alias("k2"))
    stopped = F.array_distinct(F.transform(F.filter(spaced_words("text"), with_full_stop), bare))
    found = exploded(keyed, ["k1", "k2"], stopped, "word").join(abbreviations.select("word").distinct(), "word")
    lists = found.groupBy("k1", "k2").agg(F.collect_set("word").alias("held"))
    return exploded(keyed.join(lists, ["k1", "k2"], "left"), ["index"], sentence_list("text", "held"), "pos", "sentence")


def _grams(tokens: str, length: int, no_row: str) -> str:
    """SQL of the runs of ``length`` tokens, as ``(name, start, length, row)``."""
    if length == 1:
        return f"transform({tokens}, (t, i) -> named_struct('name', t, 'start', i, 'length', 1, 'row', {no_row}))"
    starts = f"slice(transform({tokens}, (t, i) -> i), 1, greatest(size({tokens}) - {length - 1}, 0))"
    name = f"array_join(slice({tokens}, i + 1, {length}), ' ')"
    return f"transform({starts}, i -> named_struct('name', {name}, 'start', i, 'length', {length}, 'row', {no_row}))"


def _leftmost_longest(hits: Column) -> Column:
    """Of overlapping hits keep the leftmost, and of those the longest."""
    ordered = F.sort_array(hits)
    empty = F.filter(hits, lambda h: F.lit(False))
    start = F.struct(F.lit(0).alias("free"), empty.alias("kept"))
    return F.aggregate(
        ordered,
        start,
        lambda acc, h: F.when(
            h["start"] >= acc["free"],
            F.struct(
                (h["start"] - h["minus_length"]).alias("free"),
                F.concat(acc["kept"], F.array(h)).alias("kept"),
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def _render(sentence: str, hits: str) -> Column:
    """The sentence with each hit wrapped in its tag: the words up to each hit, the hit, and the words after the last, each taken once."""
    before = f"get({hits}, i - 1)"
    done = f"if(i = 0, 0, {before}.start - {before}.minus_length)"
    name = "array_join(slice(words, h.start + 1, -h.minus_length), ' ')"
    pieces = f"transform({hits}, (h, i) -> concat(slice(words, {done} + 1, h.start - {done}), array(concat('<', h.tag, '>', {name}, '</', h.tag, '>'))))"
    last = f"get({hits}, size({hits}) - 1)"
    rest = f"slice(words, {last}.start - {last}.minus_length + 1, size(words))"
    whole = bind(f"split({sentence}, ' ')", "words", f"array_join(concat(flatten({pieces}), {rest}), ' ')")
    return F.expr(f"if(size({hits}) = 0, {sentence}, {whole})")


class _Tagger:
    """Wraps the names of a dictionary in many sentences at a time."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        by_length: dict[int, list[tuple[str, str]]] = {}
        for name, tag in names:
            by_length.setdefault(name.count(" ") + 1, []).append((name, tag))
        strings = lambda items: pa.array(items, pa.string())
        self.tags = sorted({tag for _, tag in names})
        code = {tag: i for i, tag in enumerate(self.tags)}
        # of each length the names, their tags, and the words that they begin and end with
        self.names = {n: (strings([x for x, _ in held]), np.array([code[t] for _, t in held]), strings([x.split(" ", 1)[0] for x, _ in held]), strings([x.rsplit(" ", 1)[-1] for x, _ in held])) for n, held in by_length.items()}
        self.open, self.close = (strings([f"<{mark}{t}>" for t in self.tags] + [""]) for mark in ("", "/"))

    def _hits(self, flat: pa.Array, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """``(start, minus length, tag)`` of all names among the words of all sentences."""
        known = flat.dictionary_encode()
        index = known.indices.to_numpy()
        hits = []
        for n, (names, tags, firsts, lasts) in self.names.items():
            begin, end = (np.asarray(pa.compute.is_in(known.dictionary, value_set=x))[index] for x in (firsts, lasts))
            at = np.flatnonzero(begin[: max(len(index) - n + 1, 0)] & end[n - 1 :])
            at = at[owner[at] == owner[at + n - 1]]
            runs = flat.take(pa.array(at)) if n == 1 else pa.compute.binary_join_element_wise(*(flat.take(pa.array(at + i)) for i in range(n)), " ")
            found = pa.compute.fill_null(pa.compute.index_in(runs, value_set=names), -1).to_numpy()
            here = found >= 0
            hits += zip(at[here].tolist(), [-n] * int(here.sum()), tags[found[here]].tolist(), strict=True)
        return hits

    def tagged(self, sentences: pa.Array) -> pa.Array:
        """The sentences with their names wrapped, leftmost longest: a tag opens before the first word of a name and closes after its last."""
        lists = pa.compute.split_pattern(pa.compute.fill_null(sentences, ""), " ")
        lengths = lists.value_lengths().to_numpy()
        flat = lists.flatten()
        before, after = (np.full(len(flat), len(self.tags)) for _ in range(2))
        free = 0
        for start, minus, tag in sorted(self._hits(flat, np.repeat(np.arange(len(lists)), lengths))):
            if start >= free:
                free = start - minus
                before[start] = after[free - 1] = tag
        words = pa.compute.binary_join_element_wise(self.open.take(pa.array(before)), flat, self.close.take(pa.array(after)), "")
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        whole = pa.compute.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
        return pa.compute.if_else(pa.compute.is_valid(sentences), whole, pa.scalar(None, pa.string()))


def _tag_by_held(sentences: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """:func:`tag_entities` where every task knows the dictionary: nothing is shuffled."""
    held = sentences.sparkSession.sparkContext.broadcast(names)
    at = sentences.columns.index("sentence")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _Tagger(held.value)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = tagger.tagged(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return sentences.mapInArrow(tag, sentences.schema)


def tag_entities(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Wrap every dictionary name in a sentence in its tag, leftmost longest on whole tokens.

    ``gazetteer`` is ``(name, tag)``; of two tags for a name the first in order
    counts. All columns but ``sentence`` pass through. A dictionary of up to
    ``HELD_NAMES`` names is known to every task, and rows stay where they are.
    Of a larger one, the token runs of each row are joined with the dictionary,
    and only the hits, and each row once, are brought together by a 128-bit row
    key. Equal rows fold into one with a count on the map side.
    """
    names = gazetteer.groupBy("name").agg(F.min("tag").alias("tag"))
    held = names.where("name IS NOT NULL AND tag IS NOT NULL").limit(HELD_NAMES + 1).collect()
    if not held:
        return sentences
    if len(held) <= HELD_NAMES:
        return _tag_by_held(sentences, [(r["name"], r["tag"]) for r in held])
    return _tag_by_join(sentences, names)


def _tag_by_join(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """:func:`tag_entities` by joins, whatever the size of the dictionary."""
    # One row: the distinct name lengths, in tokens.
    lengths = names.where("name IS NOT NULL").agg(F.sort_array(F.collect_set(F.size(F.split("name", " "))))).first()[0]
    columns = sentences.columns
    identity = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    key = [F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit("row"), *identity).alias("k2")]
    whole = ", ".join(f"'{c}', `{c}`" for c in columns)
    # The row itself travels under a name no dictionary holds, different for each row to spread a shuffle.
    itself = f"array(named_struct('name', concat(char(1), k1), 'start', 0, 'length', 0, 'row', named_struct({whole})))"
    # Of the row's own type, so that the lists are joined as they are and not cast item by item.
    no_row = "CAST(null AS STRUCT<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in sentences.schema) + ">)"
    runs = ", ".join(_grams("tokens", length, no_row) for length in lengths)
    found = (
        exploded(sentences.select("*", *key), ["k1", "k2"], F.expr(bind("split(coalesce(sentence, ''), ' ')", "tokens", f"concat({itself}, {runs})")), "g")
        .select("k1", "k2", "g.*")
        .join(names, "name", "left")
        .where(F.col("row").isNotNull() | F.col("tag").isNotNull())
        .groupBy("k1", "k2")
        .agg(
            F.first("row", ignorenulls=True).alias("row"),
            F.count("row").cast("int").alias("copies"),
            F.collect_set(F.when(F.col("tag").isNotNull(), F.struct("start", (-F.col("length")).alias("minus_length"), "tag"))).alias("found"),
        )
        .select("row", "copies", _leftmost_longest(F.col("found")).alias("hits"))
    )
    tagged = found.select(
        *(_render("row.sentence", "hits").alias(c) if c == "sentence" else f"row.{c}" for c in columns),
        "copies",
    )
    copies = F.array_repeat(F.lit(0), F.col("copies"))
    return tagged.select(*columns, F.explode_outer(copies).alias("copy")).drop("copy")


def tag_with_model(sentences: DataFrame, load_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Tag with a user's own model: ``load_model`` runs once per task and returns sentence → tagged sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = load_model()
        for batch in batches:
            yield batch.assign(sentence=batch["sentence"].map(tag))

    return sentences.mapInPandas(run, sentences.schema)


def tag_words(sentences: DataFrame, lexicon: DataFrame, default_tag: str = "NN", folded: bool = False) -> DataFrame:
    """``(sentence_id, pos, word, tag)`` with each word's tag from ``lexicon`` ``(word, tag)``; of two tags for a word the first in order counts.

    ``folded``: ``(sentence_id, tagged)``, a row for each id with a list of the
    words and tags of its sentences, which stay rows. Every task knows
    ``HELD_NAMES`` words of the lexicon, the most frequent ones if it has a
    column ``n``. Other words are looked up by a join, each once an id, and come
    back if their tag is not the default; see :mod:`pairloom.operators.lookup`.
    """
    if folded:
        return _folded_tags(sentences, lexicon, default_tag)
    words = sentences.select("sentence_id", F.posexplode(F.split("sentence", " ")).alias("pos", "word"))
    tags = lexicon.groupBy("word").agg(F.min("tag").alias("tag"))
    return words.join(tags, "word", "left").select(
        "sentence_id", "pos", "word", F.coalesce("tag", F.lit(default_tag)).alias("tag")
    )


def _folded_tags(sentences: DataFrame, lexicon: DataFrame, default_tag: str) -> DataFrame:
    """:func:`tag_words`, a row for each id."""
    often = F.max("n") if "n" in lexicon.columns else F.lit(0)
    entries = stage(lexicon.where("word IS NOT NULL").groupBy("word").agg(F.min("tag").alias("tag"), often.alias("n")), "lexicon")
    first = entries.orderBy(F.desc("n"), "word").limit(HELD_NAMES + 1).select("word", "tag").toArrow()
    more = len(first) > HELD_NAMES
    held = sentences.sparkSession.sparkContext.broadcast(tuple(pa.array(c.to_pylist(), pa.string()) for c in first.slice(0, HELD_NAMES).columns))
    rows = sentence_rows(sentences, folded=True)
    if more:
        rows = with_answers(rows, held, entries.where(F.col("tag") != default_tag).select("word", "tag"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known = held.value
        for batch in batches:
            lists = batch.column("sentences")
            words = split_words(lists)
            different = words.flatten().dictionary_encode()
            tags = of_known.take(pa.compute.index_in(different.dictionary, value_set=known))
            if more:
                answers = batch.column("answers").flatten()
                _, at = np.unique(answers.field("word").dictionary_encode().indices.to_numpy(), return_index=True)
                answers = answers.take(pa.array(at))
                tags = pa.compute.coalesce(tags, answers.field("tag").take(pa.compute.index_in(different.dictionary, value_set=answers.field("word"))))
            tags = pa.compute.fill_null(tags, default_tag).take(different.indices)
            items = pa.StructArray.from_arrays([words, pa.ListArray.from_arrays(words.offsets, tags)], ["words", "tags"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("sentence_id"), pa.ListArray.from_arrays(offsets, items)], ["sentence_id", "tagged"])

    tagged = T.ArrayType(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("words", "tags")]))
    schema = T.StructType([sentences.schema["sentence_id"], T.StructField("tagged", tagged)])
    return rows.select("sentence_id", "sentences", *(["answers"] if more else [])).mapInArrow(tag, schema)


def prepare_corpus(articles: DataFrame, gazetteer: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """Articles ``(index, text)`` to tagged sentences ``(index, pos, sentence)``."""
    return tag_entities(split_sentences(clean_newlines(articles), abbreviations), gazetteer)
