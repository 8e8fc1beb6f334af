"""Substring dedup by seed and extend.

A window is WINDOW consecutive words of a document; it is repeated if a document with a smaller key holds the same words. Of the
SEED-word grams in a window the one of the smallest hash (the leftmost of equals) is its anchor: equal windows have equal anchors, and
the windows of one anchor are neighbours, so a document sends one row for each anchor (winnowing), not for each word.

1. Seeds: rows meet by the hash of their anchor. An anchor that only one document holds has no repeated window and is dropped.
2. Extension to both sides, as far as the windows of an anchor reach: rows meet by the hash of this whole stretch. All but those of the
   smallest document are repeated from end to end.
3. The rest (the first document of each stretch: borders of repeats) extends word by word: their windows meet by hash, and those of all
   but the smallest document are repeated.

Neighbouring repeated windows join to maximal repeats, each of at least WINDOW words, and their words are removed.

No pairs are made: every step takes the smallest key of a hash. A task first does each step among its own rows and sends one row for
a stretch, anchor or window that many of its documents hold, so a passage of a third of all documents is a row or so from each batch.
Texts travel compressed, twice, to the lists of their repeats. Hashes have 64 bits; equal hashes of different words are left to chance.

Defined results: a null or empty text has no words; a text of fewer than WINDOW words keeps them all; documents of equal keys do not
repeat each other; a null key removes nothing and nothing is removed for it. Texts of any length are taken whole. Other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import column, mixed, slices, span_hashes, staged, text_bytes, word_hashes, words

WINDOW, SEED = 13, 5
#: Bytes of text that are taken at a time: their hashes are arrays of eight times this, several at once.
PIECE_BYTES = 1 << 18
#: Rows that a task gathers before it sends what is left of them.
GATHERED = 1 << 17
#: What is known of a row: nothing, that its anchor is shared, that its windows are repeated.
OPEN, SHARED, REPEATED = 0, 1, 2
_ODD = np.random.default_rng(11).integers(1, 2**62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = "key long, stretch long, doc long, part int, item long"


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive word hashes."""
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled += h[j : j + len(rolled)] * _ODD[j]
    return mixed(rolled)


def anchors(seed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the anchor, first window and number of windows of each run of windows with one anchor.

    `seed` holds the hashes of the grams of several texts on end; the words of text t are first[t]:first[t + 1].
    """
    none = np.zeros(0, np.int64)
    if len(seed) <= WINDOW - SEED:
        return none, none, none
    # A hash with its place as the lowest bits: the least of a window is the leftmost of equals.
    bits = np.uint64(max(24, len(seed).bit_length()))
    placed = seed >> bits << bits | np.arange(len(seed), dtype=np.uint64)
    low = placed
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-1], placed[8:])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    whole = np.ones(len(place), bool)
    for end in first[1:-1].tolist():
        whole[max(end - WINDOW + 1, 0) : end] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none, none, none
    place = place[starts]
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return place[begin], starts[begin], np.diff(np.append(begin, len(starts)))


def packed(start: np.ndarray, n: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    """A run of windows as one number."""
    return start << 32 | n << 2 | state


def unpacked(item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return item >> 32, (item >> 2) & ((1 << 30) - 1), item & 3


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the first one first), and for each row in it the place of the first row with its first key."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    begin = np.concatenate([[True], k[1:] != k[:-1]])
    return order, np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))


def joined_runs(doc: np.ndarray, part: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with those that touch made one."""
    order = np.lexsort((start, part, doc))
    doc, part, start, n = doc[order], part[order], start[order], n[order]
    begin = np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + n[:-1])])
    at = np.flatnonzero(begin)
    return doc[at], part[at], start[at], np.add.reduceat(n, at)


def _scattered(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers that spread rows over all partitions."""
    return mixed(doc.astype(np.uint64) * _ODD[0] + start.astype(np.uint64) * _ODD[1]).view(np.int64)


def _sent(anchor: np.ndarray, stretch: np.ndarray, doc: np.ndarray, part: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """What a task sends of its runs of windows: repeated ones joined, one row for each stretch, one under the anchor for each anchor."""
    order, head = _groups(stretch, doc)
    again = np.zeros(len(order), bool)
    again[order] = doc[order] > doc[order[head]]
    several = np.zeros(len(order), bool)  # the stretch is in another document too
    several[order[head[again[order]]]] = True
    gone = joined_runs(doc[again], part[again], start[again], n[again]) if again.any() else (doc[:0], part[:0], start[:0], n[:0])
    anchor, stretch, doc, part, start, n, shared = (x[~again] for x in (anchor, stretch, doc, part, start, n, several))
    order, head = _groups(anchor, doc)
    other = np.zeros(len(order), bool)  # another document of the task holds the anchor
    other[order] = doc[order] != doc[order[head]]
    shared |= other
    shared[order[head[other[order]]]] = True
    key = np.where(other, stretch, anchor)
    own = _scattered(gone[0], gone[2])
    item = packed(start, n, shared.astype(np.int64))
    columns = [np.concatenate(x) for x in ((key, own), (stretch, own), (doc, gone[0]), (part, gone[1]), (item, packed(gone[2], gone[3], REPEATED)))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["key", "stretch", "doc", "part", "item"])


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the place of each text's first word."""
    data, at = text_bytes(texts)
    starts, ends, first = words(data, at)
    return word_hashes(data, starts, ends), first


def seeds(docs: DataFrame) -> DataFrame:
    """Rows (doc, part, text) to rows _ROW: key is the anchor's hash, or another where nothing has to be asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def taken() -> list[np.ndarray]:
            whole = [np.concatenate(x) for x in zip(*gathered, strict=True)]
            gathered.clear()
            return whole

        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                # of a slice at a time, since it copies the texts
                piece = piece.filter(piece.column("doc").is_valid())
                if not piece.num_rows:
                    continue
                h, first = _hashed(piece.column("text"))
                seed = grams(h, SEED)
                place, start, n = anchors(seed, first)
                text = np.searchsorted(first, start, side="right") - 1
                doc = np.asarray(piece.column("doc"))[text]
                part = np.asarray(piece.column("part"))[text]
                gathered.append((seed[place].view(np.int64), span_hashes(h, start, start + n + WINDOW - 1).view(np.int64), doc, part, start - first[text], n))
                rows += len(place)
                del h, seed
                if rows >= GATHERED:
                    yield _sent(*taken())
                    rows = 0
        if rows:
            yield _sent(*taken())

    return docs.mapInArrow(run, _ROW)


def _state(item: Column) -> Column:
    return item.bitwiseAND(F.lit(3))


def extended(rows: DataFrame) -> DataFrame:
    """(doc, part, items): runs of windows of each document, repeated ones and those still to be looked at (SHARED)."""
    same = Window.partitionBy("key")
    alone = (F.min("doc").over(same) == F.max("doc").over(same)) & (F.max(_state(F.col("item"))).over(same) == OPEN)
    found = rows.withColumn("alone", alone).where(~F.col("alone")).drop("alone", "key")
    smaller = F.min("doc").over(Window.partitionBy("stretch")) < F.col("doc")
    kind = F.when((_state(F.col("item")) == REPEATED) | smaller, REPEATED).otherwise(SHARED)
    found = found.withColumn("kind", kind)
    item = F.shiftleft(F.shiftright("item", 2), 2) + F.col("kind")
    return found.select("doc", "part", item.alias("item")).groupBy("doc", "part").agg(F.collect_list("item").alias("items"))


def _compressed(docs: DataFrame) -> DataFrame:
    """(doc, part, size, zipped) of rows (doc, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                texts = [(x or "").encode() for x in piece.column("text").to_pylist()]
                zipped = pa.array([codec.compress(x, asbytes=True) if x else b"" for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("part"), pa.array([len(x) for x in texts], pa.int64()), zipped], ["doc", "part", "size", "zipped"])

    return docs.select("doc", "part", "text").mapInArrow(run, "doc long, part int, size long, zipped binary")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for size, zipped in zip(batch.column("size").to_pylist(), batch.column("zipped"), strict=True):
        yield codec.decompress(zipped.as_buffer(), size, asbytes=True) if size else b""


def _unzipped(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that have about PIECE_BYTES of text together, as `text`; a longer text is taken alone."""
    ends = np.cumsum(np.asarray(batch.column("size")))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        piece = batch.slice(start, stop - start)
        yield piece.append_column("text", pa.array(list(_texts(piece)), pa.binary()))
        start = stop


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of the lists, and the number of the list that each belongs to."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    return np.asarray(pa.compute.list_flatten(lists), np.int64), np.repeat(np.arange(len(lists)), sizes)


def border_windows(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, part, starts): the repeated windows among those still to be looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gathered = []
            for piece in _unzipped(batch):
                h, first = _hashed(piece.column("text"))
                item, of = _flat(piece.column("items"))
                start, n, state = unpacked(item)
                asked = np.flatnonzero(state == SHARED)
                of, start, n = np.repeat(of[asked], n[asked]), np.repeat(start[asked], n[asked]), n[asked]
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                window = grams(h, WINDOW)[start + first[of]].view(np.int64)
                gathered.append((window, np.asarray(piece.column("doc"))[of], np.asarray(piece.column("part"))[of], start))
            if not gathered:
                continue
            window, doc, part, start = (np.concatenate(x) for x in zip(*gathered, strict=True))
            order, head = _groups(window, doc)
            again = np.zeros(len(order), bool)
            again[order] = doc[order] > doc[order[head]]
            window = np.where(again, _scattered(doc, start), window)
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(doc), pa.array(part, pa.int32()), pa.array(start), pa.array(again)], ["window", "doc", "part", "start", "again"])

    asked = lists.where(F.exists("items", lambda x: _state(x) == SHARED))
    rows = _compressed(docs).join(asked, ["doc", "part"]).select("doc", "part", "items", "size", "zipped")
    rows = rows.mapInArrow(run, "window long, doc long, part int, start long, again boolean")
    smaller = F.min("doc").over(Window.partitionBy("window")) < F.col("doc")
    found = rows.withColumn("smaller", smaller).where(F.col("again") | F.col("smaller"))
    return found.groupBy("doc", "part").agg(F.collect_list("start").alias("starts"))


def numbered_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, part, text): different texts of one key are told apart by `part`; it is 0 where a key has one text."""
    rows = docs.select(column(id_col).cast("long").alias("doc"), column(text_col).alias("text"))
    known = rows.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("name"))
    several = known.groupBy("doc").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("doc")
    several = staged(known.join(several, "doc").distinct())
    parts = several.select("doc", "name", F.row_number().over(Window.partitionBy("doc").orderBy("name")).alias("part"))
    return rows.withColumn("name", F.xxhash64("text")).join(staged(parts), ["doc", "name"], "left").select("doc", F.coalesce("part", F.lit(0)).alias("part"), "text")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(doc, part, repeats): the maximal runs of repeated words of rows (doc, part, text), as (start, length) in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, of = _flat(batch.column("items"))
            start, n, state = unpacked(item)
            gone = state == REPEATED
            single, of_single = _flat(batch.column("starts"))
            of = np.concatenate([of[gone], of_single])
            start = np.concatenate([start[gone], single])
            end = np.concatenate([(start[: gone.sum()] + n[gone]), single + 1]) + WINDOW - 1
            order = np.lexsort((start, of))
            of, start, end = of[order], start[order], end[order]
            # Runs that overlap or touch are one; the furthest end so far is looked at within each document.
            shift = of * (1 << 40)
            furthest = np.maximum.accumulate(end + shift) if len(end) else end
            begin = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > furthest[:-1]])) if len(end) else np.zeros(0, np.int64)
            stop = furthest[np.append(begin[1:], len(end)) - 1] - shift[begin] if len(end) else end
            rows, counts = np.unique(of[begin], return_counts=True)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.StructArray.from_arrays([pa.array(start[begin]), pa.array(stop - start[begin])], ["start", "length"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows)), batch.column("part").take(pa.array(rows)), lists], ["doc", "part", "repeats"])

    lists = staged(extended(seeds(docs)))
    known = lists.select("doc", "part", F.filter("items", lambda x: _state(x) == REPEATED).alias("items")).where(F.size("items") > 0)
    empty = F.array().cast("array<long>")
    both = known.join(border_windows(docs, lists), ["doc", "part"], "full")
    both = both.select("doc", "part", F.coalesce("items", empty).alias("items"), F.coalesce("starts", empty).alias("starts"))
    return both.mapInArrow(run, "doc long, part int, repeats array<struct<start long, length long>>")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept, repeats: every row's words that are left, joined by one space, and the runs of words removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _unzipped(batch):
                n_words, n_removed, kept = [], [], []
                for text, repeats in zip(piece.column("text").to_pylist(), piece.column("repeats").to_pylist(), strict=True):
                    left = text.split()  # at the bytes 9 to 13 and 32
                    n_words.append(len(left))
                    for r in reversed(repeats or ()):
                        del left[r["start"] : r["start"] + r["length"]]
                    n_removed.append(n_words[-1] - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), piece.column("repeats")], ["key", "n_words", "n_removed", "kept", "repeats"])

    rows = numbered_parts(docs, id_col, text_col)
    repeats = staged(maximal_repeats(rows))
    met = _compressed(rows).join(repeats, ["doc", "part"], "left").select("doc", "size", "zipped", "repeats")
    return met.mapInArrow(run, "key long, n_words long, n_removed long, kept string, repeats array<struct<start long, length long>>")
