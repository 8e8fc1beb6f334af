"""Part-of-speech tags that depend on the words around: a bigram hidden Markov model.

The model is counted from tagged text: which tag follows which, and which words a tag has. Scores are costs, negative logarithms as
whole numbers, so that sums and ties do not depend on the order of rows.

Words that have one possible tag cut a sentence into runs: the best path goes through that tag, whatever stands on either side. So
each run of ambiguous words is decoded alone, with the tags on both sides, and gives the same tags as decoding the sentence at once.

Sentences stay rows. A task knows the most frequent words, the shapes and the costs of the chain, which are of fixed bounds; the
other words of a sentence that the model may know are looked up by a join, and their tags come back to the sentence as one list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.tagged import exploded
from pairloom.operators.lookup import sentence_rows, split_words, with_answers
from pairloom.staging import stage

#: Costs are whole numbers of this part of a natural logarithm.
UNIT = 1_000_000
#: More tags than this are taken for broken input and fail the job, since every pair of tags has a cost.
MOST_TAGS = 500
#: Words whose tags every task knows, the most frequent ones, so that none of them is a key of a shuffle.
FREQUENT_WORDS = 50_000
#: Numbers in the largest array of a step of the decoder, unless a single run needs more.
STEP_NUMBERS = 1 << 21
#: Shapes of words that the model does not know, tried in order; lower-case words go by their last two letters.
SHAPES = [("^[0-9]+([.,][0-9]+)*$", "number"), ("^[^A-Za-z0-9]+$", "mark"), ("^[A-Z][a-z]+$", "capital"), ("^[A-Z]+$", "upper")]
_LOWER = "^[a-z]+$"
_LINE_END = "[\n\r\u0085\u2028\u2029]"


@dataclass(frozen=True)
class TagModel:
    """``words`` (word, n, tags) and ``shapes`` (shape, tags) with the possible tags as (tag number, cost), and in one row ``chain``
    (names, costs): names of the tags in order, and the cost of each tag (or the end) after each tag (or the start)."""

    words: DataFrame
    shapes: DataFrame
    chain: DataFrame


def shape_of(word: str) -> Column:
    """The shape of a word, with the ending of a lower-case word after a dash."""
    shape = F.when(F.regexp_like(word, F.lit(_LOWER)), F.concat(F.lit("lower-"), F.substring(word, -2, 2)))
    for pattern, name in SHAPES:
        shape = shape.when(F.regexp_like(word, F.lit(pattern)), name)
    return shape.otherwise("other")


def _cost(share: Column) -> Column:
    return F.round(-F.ln(share) * UNIT).cast("bigint")


def _word_steps(tagged: DataFrame) -> DataFrame:
    """``(a, b, word, n)``: how often a word of tag b follows tag a; null stands for the start, and as b, without a word, for the end.

    Items are cut at the last underscore, each different one of a batch once; those without a word or a tag, or with a line end in the
    word, are left out. Equal steps of a batch are one row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.compute.split_pattern(batch.column("text"), " ")
            owner = np.repeat(np.arange(len(batch)), pa.compute.fill_null(lists.value_lengths(), 0).to_numpy())
            known = lists.flatten().dictionary_encode()
            words, tags, tag_of = [], {}, np.full(len(known.dictionary), -1, np.int64)
            for i, item in enumerate(known.dictionary.to_pylist()):
                word, _, tag = item.rpartition("_")
                words.append(word)
                if word and tag and not re.search(_LINE_END, word):
                    tag_of[i] = tags.setdefault(tag, len(tags))
            index = known.indices.to_numpy()
            taken = tag_of[index] >= 0
            owner, index, at = owner[taken], index[taken], tag_of[index][taken]
            edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(1, np.int64)
            before = np.roll(at, 1)
            before[edge[:-1]] = len(tags)
            steps, n = np.unique(before * len(words) + index, return_counts=True)
            a, item = np.divmod(steps, max(len(words), 1))
            ends, n_ends = np.unique(at[edge[1:] - 1], return_counts=True)
            names, none = pa.array([*tags, None], pa.string()), np.full(len(ends), len(tags))
            columns = [names.take(pa.array(np.concatenate(x).astype(np.int64))) for x in ((a, ends), (tag_of[item], none))]
            of_word = pa.concat_arrays([pa.array(words, pa.string()).take(pa.array(item)), pa.nulls(len(ends), pa.string())])
            yield pa.RecordBatch.from_arrays([*columns, of_word, pa.array(np.concatenate([n, n_ends]).astype(np.int64))], ["a", "b", "word", "n"])

    rows = tagged.select("text").mapInArrow(count, "a string, b string, word string, n long")
    return rows.groupBy("a", "b", "word").agg(F.sum("n").alias("n"))


def learn_tags(tagged: DataFrame) -> TagModel:
    """Count a model from tagged sentences ``(text)`` of the form ``word_TAG word_TAG``.

    A tag has a known word with its share of occurrences; the share of its
    distinct words stands for words not seen yet, split by their shape. A tag
    follows a tag with its share plus one, so nothing is impossible. Null and
    empty texts teach nothing. The texts are read once: words are counted by the
    tag before them, with map-side aggregation, and both counts are sums of these.
    """
    seen = stage(_word_steps(tagged), "word-steps")
    counts = stage(seen.where("b IS NOT NULL").groupBy("word", F.col("b").alias("tag")).agg(F.sum("n").alias("n")), "word-tags")
    followed = seen.groupBy("a", "b").agg(F.sum("n").alias("n"))
    of_tag = counts.groupBy("tag").agg(F.sum("n").alias("n_tag"), F.count(F.lit(1)).alias("kinds"))
    end = F.array(F.lit(None).cast("string"))
    many = F.raise_error(F.lit(f"more than {MOST_TAGS} different tags"))
    names = stage(of_tag.agg(F.sort_array(F.collect_set("tag")).alias("names"), F.count(F.lit(1)).alias("t")).select("names", F.when(F.col("t") > MOST_TAGS, many.cast("bigint")).otherwise(F.col("t")).alias("t")), "tags")
    # one row for each pair of numbers; the number after the last tag is the start, or the end
    numbered = names.select(F.posexplode(F.concat("names", end)).alias("number", "tag"))
    a, b = numbered.toDF("na", "a"), numbered.toDF("nb", "b")
    known = followed.join(F.broadcast(a), followed["a"].eqNullSafe(a["a"])).join(F.broadcast(b), followed["b"].eqNullSafe(b["b"])).select("na", "nb", "n")
    pairs = names.select(F.col("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("t") + 1) * (F.col("t") + 1) - 1)).alias("at"))
    pairs = pairs.select("t", "at", F.expr("CAST(at div (t + 1) AS INT)").alias("na"), F.expr("CAST(at % (t + 1) AS INT)").alias("nb"))
    filled = pairs.join(known, ["na", "nb"], "left").select("t", "at", "na", F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.groupBy("na").agg(F.sum("n").alias("total"))
    costs = filled.join(total, "na").select("at", _cost((F.col("n") + 1) / (F.col("total") + F.col("t") + 1)).alias("cost"))
    chain = costs.agg(F.sort_array(F.collect_list(F.struct("at", "cost")))["cost"].alias("costs")).join(F.broadcast(names.select("names")))
    of_tag = F.broadcast(stage(of_tag.join(F.broadcast(numbered), "tag"), "tag-sizes"))
    own = counts.join(of_tag, "tag")
    possible = lambda n: F.struct(F.col("number").alias("tag"), _cost(n / (F.col("n_tag") + F.col("kinds"))).alias("cost"))
    words = own.groupBy("word").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(possible(F.col("n")))).alias("tags"))
    shapes = own.select("tag", shape_of("word").alias("shape")).groupBy("tag", "shape").agg(F.count(F.lit(1)).alias("m"))
    shapes = shapes.unionByName(shapes.where("shape LIKE 'lower-%'").groupBy("tag").agg(F.lit("lower").alias("shape"), F.sum("m").alias("m")))
    shapes = shapes.unionByName(of_tag.select("tag", F.lit("").alias("shape"), F.col("kinds").alias("m")))
    shapes = shapes.join(of_tag, "tag").groupBy("shape").agg(F.sort_array(F.collect_list(possible(F.col("m")))).alias("tags"))
    return TagModel(stage(words, "tag-words"), stage(shapes, "tag-shapes"), stage(chain, "tag-chain"))


def _matches(pattern: str, word: str) -> bool:
    """As in Spark, where ``$`` stands before a last line end of any kind, too."""
    return re.search(pattern.replace("$", f"(?=(?:\r\n|{_LINE_END})?\\Z)"), word) is not None


def _shapes(word: str) -> tuple[str, str, str]:
    """:func:`shape_of` of a word, its coarser shape, and that of all words."""
    if _matches(_LOWER, word):
        return f"lower-{word[-2:]}", "lower", ""
    found = next((name for pattern, name in SHAPES if _matches(pattern, word)), "other")
    return found, found, ""


class _Decoder:
    """Tags of whole sentences, many at a time, from the parts of a model that are of fixed size."""

    def __init__(self, names: list[str], costs: list[int], frequent: list, shapes: list) -> None:
        self.names = pa.array(names, pa.string())
        self.costs = np.array(costs, np.int64).reshape(len(names) + 1, len(names) + 1)
        self.frequent = {word: tuple(map(tuple, tags)) for word, tags in frequent}
        self.shapes = {shape: tuple(map(tuple, tags)) for shape, tags in shapes}

    def _choices(self, words: list[str], rare: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the row of its choices; of each row their tags and costs, filled up, and their number."""
        number: dict[tuple, int] = {}
        rows = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            tags = self.frequent.get(word) or rare.get(word) or next(x for x in map(self.shapes.get, _shapes(word)) if x)
            rows[i] = number.setdefault(tags, len(number))
        size = np.array([len(x) for x in number], np.int64)
        tags, costs = np.zeros((len(number), size.max()), np.int64), np.full((len(number), size.max()), 1 << 60, np.int64)
        for i, x in enumerate(number):
            tags[i, : len(x)], costs[i, : len(x)] = zip(*x, strict=True)
        return rows, tags, costs, size

    def tags(self, words: pa.ListArray, rare: dict[str, tuple]) -> pa.Array:
        """The tags of lists of words; ``rare`` holds the tags of words of the model that are not frequent."""
        lengths = words.value_lengths().to_numpy()
        ends = np.cumsum(lengths)
        flat = words.flatten()
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        if not len(self.names) or not len(flat):
            return pa.ListArray.from_arrays(offsets, pa.nulls(len(flat), pa.string()))
        known = flat.dictionary_encode()
        rows, tags, costs, size = self._choices(known.dictionary.to_pylist(), rare)
        row = rows[known.indices.to_numpy()]
        found = tags[row, 0]
        open_ = size[row] > 1
        first, last = np.zeros(len(row), bool), np.zeros(len(row), bool)
        first[(ends - lengths)[lengths > 0]] = last[(ends - 1)[lengths > 0]] = True
        begin = np.flatnonzero(open_ & (first | ~np.roll(open_, 1)))
        end = np.flatnonzero(open_ & (last | ~np.roll(open_, -1)))
        edge = len(self.names)
        before = np.where(first[begin], edge, found[begin - 1])
        after = np.where(last[end], edge, found[(end + 1) % len(row)])
        long = end - begin + 1
        order = np.argsort(-long, kind="stable")
        part = max(STEP_NUMBERS // tags.shape[1] ** 2, 1)
        for at in range(0, len(order), part):
            runs = order[at : at + part]
            self._decode(row, tags, costs, found, begin[runs], long[runs], before[runs], after[runs])
        return pa.ListArray.from_arrays(offsets, self.names.take(pa.array(found)))

    def _decode(self, row, tags, costs, found, begin, long, before, after) -> None:
        """Viterbi's recursion on many runs, the longest first; of equal costs the lowest tag at each step. Sets the tags in ``found``."""
        now = row[begin]
        total = costs[now] + self.costs[before[:, None], tags[now]]
        back = []
        for i in range(1, long[0]):
            m = int(np.searchsorted(-long, -i, "left"))  # the runs of more than i words
            then, now = row[begin[:m] + i - 1], row[begin[:m] + i]
            steps = total[:m, :, None] + self.costs[tags[then][:, :, None], tags[now][:, None, :]]
            best = steps.argmin(axis=1)
            back.append(best.astype(np.uint16))
            total[:m] = np.take_along_axis(steps, best[:, None, :], 1)[:, 0] + costs[now]
        pick = (total + self.costs[tags[row[begin + long - 1]], after[:, None]]).argmin(axis=1)
        for i in range(long[0] - 1, -1, -1):
            m = int(np.searchsorted(-long, -i, "left"))
            found[begin[:m] + i] = tags[row[begin[:m] + i], pick[:m]]
            if i:
                pick[:m] = back[i - 1][np.arange(m), pick[:m]]


def _rare_tags(lists: pa.ListArray) -> dict[str, tuple]:
    """Tags by word of the lists ``(word, tags)`` of a batch, each word taken once."""
    flat = lists.flatten()
    words = flat.field("word").dictionary_encode()
    _, firsts = np.unique(words.indices.to_numpy(), return_index=True)
    return {x["word"]: tuple((t["tag"], t["cost"]) for t in x["tags"]) for x in flat.take(pa.array(firsts)).to_pylist()}


def tag_sentences(sentences: DataFrame, model: TagModel, folded: bool = False) -> DataFrame:
    """``(sentence_id, words, tags)``: each sentence as a row, cut at single spaces, with the most probable tags of the whole.

    Null sentences are left out, an empty one has an empty word; repeated rows
    are tagged each; a model without words gives null tags. Without words beyond
    the frequent ones nothing is shuffled. Else the words that are not frequent
    are joined with the model's, each once a sentence, and those found come back
    to the sentence by a 64-bit key; see :mod:`pairloom.operators.lookup`.

    ``folded``: ``(sentence_id, tagged)``, a row for each id with a list of the
    words and tags of its sentences. These are brought together before they are
    tagged, when a row is its text.
    """
    spark = sentences.sparkSession
    frequent = [(r["word"], r["tags"]) for r in model.words.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS + 1).collect()]
    some_rare, frequent = len(frequent) > FREQUENT_WORDS, frequent[:FREQUENT_WORDS]
    chain = model.chain.first()
    parts = ([tags for _, tags in frequent], chain["names"], chain["costs"], [(r["shape"], r["tags"]) for r in model.shapes.collect()])
    held = spark.sparkContext.broadcast((pa.array([word for word, _ in frequent], pa.string()), *parts))
    rows = sentence_rows(sentences, folded)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known, names, costs, shapes = held.value
        decoder = _Decoder(names, costs, zip(known.to_pylist(), of_known, strict=True), shapes)
        for batch in batches:
            rare = _rare_tags(batch.column("answers")) if some_rare else {}
            lists = batch.column("sentences")
            words = split_words(lists)
            columns = [words, decoder.tags(words, rare)]
            if folded:
                offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["words", "tags"]))]
            yield pa.RecordBatch.from_arrays([batch.column("sentence_id"), *columns], schema.names)

    if some_rare:
        rows = with_answers(rows, held, model.words.select("word", "tags"))
    fields = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("words", "tags")]
    if folded:
        fields = [T.StructField("tagged", T.ArrayType(T.StructType(fields)))]
    schema = T.StructType([sentences.schema["sentence_id"], *fields])
    return rows.select("sentence_id", "sentences", *(["answers"] if some_rare else [])).mapInArrow(tag, schema)


def tag_in_context(sentences: DataFrame, model: TagModel) -> DataFrame:
    """``(sentence_id, pos, word, tag)``: a row for each word of :func:`tag_sentences`."""
    items = F.arrays_zip("words", "tags")
    return exploded(tag_sentences(sentences, model), ["sentence_id"], items, "pos", "i").select("sentence_id", "pos", F.col("i.words").alias("word"), F.col("i.tags").alias("tag"))
