"""Benchmark decontamination with suffix arrays of the training texts.

Every batch of documents is a shard. Its suffix array holds the word positions at which a test window could begin (those whose first
two words begin one), sorted by the words that follow. Every test suffix is found in it by binary search, which gives all places that
hold its first `window` words; places that follow one another are put together into the longest verbatim matches. Documents stay where
they are: no shuffle, and the memory of a task is that of one slice of text. The test items travel to the tasks in blocks of bounded
size, one pass over the documents for each block.

Defined results: null or word-less texts and items have no matches; an item shorter than the window is one window; equal items match
alike; a null item_id has matches that count as hits but gives no id; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ALPHANUMERIC, LOWERED, column, slices, text_bytes, unused, word_hashes, words

#: Characters of test items that travel at once.
BLOCK_CHARS = 8 << 20
MATCHES = "array<struct<start:int,length:int,item_id:string>>"


@dataclass(frozen=True)
class TestBlock:
    """Test windows as rows of word numbers (0 beyond a short item), the item of each, and the words behind the numbers."""

    window: int
    ids: list[str | None]
    vocabulary: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    pairs: np.ndarray


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(texts)
    lowered = LOWERED[data]
    starts, ends, first = words(lowered, at, ALPHANUMERIC)
    return word_hashes(lowered, starts, ends), first


def _pairs(numbers: np.ndarray) -> np.ndarray:
    return numbers[:, 0].astype(np.int64) << 32 | numbers[:, 1].astype(np.int64)


def test_block(ids: list[str | None], texts: list[str | None], window: int) -> TestBlock:
    """All windows of the texts, with the ids of their items."""
    codes, first = _tokens(pa.array(texts, pa.large_string()))
    vocabulary = np.unique(codes)
    numbers = np.concatenate([np.searchsorted(vocabulary, codes) + 1, np.zeros(window, np.int64)])
    begin, lengths, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            begin.append(np.arange(a, max(b - window, a) + 1))
            lengths.append(np.full(len(begin[-1]), min(window, b - a)))
            items.append(np.full(len(begin[-1]), k))
    begin, lengths, items = map(np.concatenate, (begin, lengths, items))
    rows = numbers[begin[:, None] + np.arange(window)]
    rows[np.arange(window) >= lengths[:, None]] = 0
    return TestBlock(window, ids, vocabulary, rows.astype(np.uint32), lengths, items, np.unique(_pairs(rows[:, :2] if window > 1 else np.pad(rows, ((0, 0), (0, 1))))))


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def shard_matches(texts: pa.Array, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the longest matches: text, first word, words, item."""
    codes, first = _tokens(texts)
    w, total = block.window, len(codes)
    none = np.zeros(0, np.int64)
    if not total or not len(block.rows):
        return np.diff(first), none, none, none, none
    place = np.minimum(np.searchsorted(block.vocabulary, codes), len(block.vocabulary) - 1)
    numbers = np.zeros(total + w + 1, np.uint32)
    numbers[:total] = np.where(block.vocabulary[place] == codes, place + 1, 0)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][owner] - np.arange(total)
    known = np.flatnonzero(numbers[:total])
    second = np.where(left[known] > 1, numbers[known + 1], 0)
    pair = numbers[known].astype(np.int64) << 32
    suffixes = known[np.isin(pair | second, block.pairs) | np.isin(pair, block.pairs)]
    rows = numbers[suffixes[:, None] + np.arange(w)]
    rows[np.arange(w) >= left[suffixes][:, None]] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = suffixes[order], keys[order]
    low = np.searchsorted(keys, _keys(block.rows), "left")
    ceiling = np.where(np.arange(w) >= block.lengths[:, None], np.uint32(0xFFFFFFFF), block.rows)
    high = np.searchsorted(keys, _keys(ceiling), "right")
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    at = suffixes[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    # a window that follows on the last one, both in the item and in the text, lengthens its match
    order = np.lexsort((at, at - which, block.items[which]))
    which, at = which[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1] + 1) | (block.items[which][1:] != block.items[which][:-1]) | (owner[at][1:] != owner[at][:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    text = owner[at[begin]]
    return np.diff(first), text, at[begin] - first[:-1][text], at[last] - at[begin] + block.lengths[which[last]], block.items[which[begin]]


def matched(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_text_col: str = "text", item_id_col: str = "item_id", window: int = 10) -> tuple[DataFrame, str]:
    """All rows and columns of docs and a struct column (n_words, n_hit, matches); also that column's name.

    matches: start and length in words, and the item_id as a string. Items come to the driver one block after the other.
    """
    name, held = unused(docs, "matched"), unused(docs, "matches")
    place = docs.columns.index(text_col)
    result = docs.withColumn(held, F.array().cast(MATCHES)).withColumn(name, F.lit(0))

    def find(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                plain = batch.rename_columns([str(i) for i in range(batch.num_columns)])
                for part in slices(plain, str(place)):
                    count, text, start, length, item = shard_matches(part.column(place), block)
                    old = part.column(part.num_columns - 2)
                    order = np.argsort(text, kind="stable")
                    named = pa.array(block.ids, pa.string()).take(pa.array(item[order]))
                    found = pa.StructArray.from_arrays([pa.array(start[order], pa.int32()), pa.array(length[order], pa.int32()), named], ["start", "length", "item_id"])
                    bounds = np.searchsorted(text[order], np.arange(part.num_rows + 1))
                    new = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)
                    if len(old.flatten()):
                        new = pa.array([(a or []) + (b or []) for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], new.type)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], new, pa.array(count, pa.int32())], batch.schema.names)

        return run

    schema = result.schema
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = blocks = 0

    def searched(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(find(docs.sparkSession.sparkContext.broadcast(test_block(ids, texts, window))), schema)

    for item_id, text in items.select(column(item_id_col).cast("string"), column(item_text_col)).toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text or "")
        if size >= BLOCK_CHARS:
            result, ids, texts, size, blocks = searched(result), [], [], 0, blocks + 1
    if texts or not blocks:
        result = searched(result)
    spans = F.array_sort(F.transform(column(held), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end"))))
    # words covered by spans in order of their starts: what each adds beyond the furthest end so far
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(spans, zero, lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("hit"), F.greatest(a["end"], s["end"]).alias("end")))["hit"]
    return result.withColumn(name, F.struct(column(name).cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), column(held).alias("matches"))).drop(held), name


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their columns, that hold no test window."""
    rows, name = matched(docs, items, **options)
    return rows.where(F.col(name)["n_hit"] == 0).select(*[column(c) for c in docs.columns])


def item_digest(matches) -> tuple:
    """Number of different items, and the sha256 of their sorted ids joined by commas."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(matches, lambda m: m["item_id"]), lambda x: x.isNotNull())))
    return F.size(ids).cast("long"), F.sha2(F.array_join(ids, ",").cast("binary"), 256)
