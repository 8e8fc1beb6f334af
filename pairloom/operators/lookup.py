"""Words of sentences that are looked up in a table which is too large for a task.

Sentences stay rows. A row asks, by a 64-bit key, for those of its words that its task does not know, and the answers come back to it as
one list. Rows of one key get each other's answers as well, which changes nothing: an answer names its word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_rows(sentences: DataFrame, folded: bool) -> DataFrame:
    """``(k, sentence_id, sentences)`` of ``(sentence_id, sentence)``, without null sentences.

    A row for each sentence, or, ``folded``, for each id with the sentences of
    it. These are dealt by ``k``, so that a join by ``k`` moves none of them
    again; what is shuffled is the plain text.
    """
    if folded:
        dealt = sentences.select(F.xxhash64("sentence_id").alias("k"), "sentence_id", "sentence").repartition("k")
        return dealt.groupBy("k", "sentence_id").agg(F.collect_list("sentence").alias("sentences")).where(F.size("sentences") > 0)
    # Exploding a list of one keeps the filter above the text: below, a sentence that is rendered would be rendered once more.
    once = sentences.select("sentence_id", F.explode_outer(F.array("sentence")).alias("sentence")).where(F.col("sentence").isNotNull())
    return once.select(F.xxhash64("sentence_id", "sentence").alias("k"), "sentence_id", F.array("sentence").alias("sentences"))


def split_words(sentences: pa.ListArray) -> pa.ListArray:
    """The words of each sentence, from lists of sentences, cut at single spaces."""
    return pa.compute.split_pattern(sentences.flatten(), " ")


def with_answers(rows: DataFrame, held: Broadcast, table: DataFrame) -> DataFrame:
    """:func:`sentence_rows` with ``answers``, the rows of ``table`` (word, ...) for those words that ``held`` (words, ...) lacks; null: none.

    A frequent word that is in neither is a key of the join with the table, and
    left to adaptive execution.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        for batch in batches:
            lists = batch.column("sentences")
            words = split_words(lists)
            at = np.repeat(np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), words.value_lengths().to_numpy())
            different = words.flatten().dictionary_encode()
            index = different.indices.to_numpy()
            new = np.asarray(pa.compute.invert(pa.compute.is_in(different.dictionary, value_set=known)))[index]
            at, index = np.divmod(np.unique(at[new] * len(different.dictionary) + index[new]), max(len(different.dictionary), 1))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at)), different.dictionary.take(pa.array(index))], ["k", "word"])

    # Dealt as rows: gathering lists before the shuffle would sort them and save nothing.
    found = rows.mapInArrow(ask, "k long, word string").join(table, "word").repartition("k")
    lists = found.groupBy("k").agg(F.collect_set(F.struct(*table.columns)).alias("answers"))
    return rows.join(lists, "k", "left")
