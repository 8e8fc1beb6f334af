"""Token ids as Arrow files of equal-length sequences.

Documents are tokenized where they are, dealt out by ranges of their key, and each range becomes one file in Arrow's file format:
record batches of `BATCH_ROWS` rows, each row a fixed-size list of ids and a fixed-size list of mask bits. Row i of a file is row
i % BATCH_ROWS of batch i // BATCH_ROWS, at a fixed place of a memory map: random access without copying. A file is filled without gaps,
its last sequence is padded and masked. Beside it lies an index file (key, start, length). A task writes files under new names and
reports them, so a task that runs again leaves nothing that anybody reads.

Defined results: a null text is an empty one (only the end id); null keys come first; rows of equal keys follow one another, ordered by
their ids; an empty table gives no rows. Keys are integers.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import column, slices, staged

BATCH_ROWS = 256
#: Different words whose ids a worker remembers.
REMEMBERED = 900_000
#: New words that are encoded as one text.
TOGETHER = 256
#: White space beside a space: such a text is encoded in one piece.
_RUN = re.compile(r" \s|\s ")
FILES = "part int, file string, n_docs long, n_tokens long, n_sequences long"


class _Words(dict):
    """Numbers of words, given out as they come; new ones wait in `pending`."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(" " + word)
        return n


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each different word once.

    Its splitting into words never joins a single space to what is before it, so a text may be cut there, and the pieces' ids
    put together are those of the text. For the same reason new words are encoded many at a time, and their ids are cut before
    the tokens that begin with a space; where there is not one such token for each word, the words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # of a byte-level vocabulary, which writes a space as this letter
        self.spaced = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.spaced[[n for token, n in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.sizes = _Words(), array("I"), array("q")

    def _learn(self, pending: list[str]) -> None:
        """Keep the ids of new words, each with the space before it."""
        groups = [pending[i : i + TOGETHER] for i in range(0, len(pending), TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(group) and first[0] == 0:
                self.flat.frombytes(ids.tobytes())
                self.sizes.frombytes(np.diff(first, append=len(ids)).astype(np.int64).tobytes())
                continue
            for alone in self.tokenizer.encode_batch_fast(group, add_special_tokens=False):
                self.flat.extend(alone.ids)
                self.sizes.append(len(alone.ids))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text starts (and the last one ends)."""
        if len(self.words) > REMEMBERED:
            self._forget()
        number = self.words.__getitem__
        alone: list[str] = []
        pieces: list[int] = []
        ends = []
        for text in texts:
            first, *rest = [text] if _RUN.search(text) else text.split(" ")
            alone.append(first)
            pieces.append(-2 * len(alone))
            pieces.extend(map(number, rest))
            pieces.append(-1)
            ends.append(len(pieces))
        self._learn(self.words.pending)
        self.words.pending.clear()
        known = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        known_sizes = np.frombuffer(self.sizes, np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        singles = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        # one table: the words, the end id, the texts' first pieces
        table = np.concatenate([known, np.array([end_id], np.uint32), *singles])
        sizes = np.concatenate([known_sizes, [1], [len(x) for x in singles]]).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        rows = np.array(pieces, np.int64)
        rows = np.where(rows == -1, len(known_sizes), np.where(rows < 0, len(known_sizes) - rows // 2, rows))
        count = sizes[rows]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = table[np.repeat(at[rows] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, np.concatenate([[0], upto[np.array(ends, np.int64)]])


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _SequenceFile:
    """Fills one file and its index."""

    def __init__(self, folder: str, part: int, length: int, kind: np.dtype, key_type: pa.DataType):
        self.part, self.length, self.kind = part, length, kind
        self.name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
        system, path = _filesystem(self.name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        size = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("input_ids", size), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("key", key_type), ("start", pa.int64()), ("length", pa.int64())])
        self.streams = [system.open_output_stream(path), system.open_output_stream(path + ".index")]
        self.data = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], self.index_schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.docs = self.sequences = 0

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.waiting += ids
        self.held += int(sizes.sum())
        self.tokens += int(sizes.sum())
        self.docs += len(ids)
        if self.held >= BATCH_ROWS * self.length:
            self._flush(BATCH_ROWS * self.length)

    def _flush(self, multiple: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        full = len(ids) // multiple * multiple
        for at in range(0, full, BATCH_ROWS * self.length):
            self._write(ids[at : min(at + BATCH_ROWS * self.length, full)], self.length * BATCH_ROWS)
        self.waiting, self.held = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(np.ascontiguousarray(ids, self.kind)), mask)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> tuple:
        self._flush(BATCH_ROWS * self.length)
        rest = self.waiting[0]
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        for x in (self.data, self.index, *self.streams):
            x.close()
        return self.part, self.name, self.docs, self.tokens, self.sequences


def write_sequences(docs: DataFrame, folder: str, *, tokenizer: str, vocabulary: int, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a folder that all executors share; one row per file (FILES), in the order of the keys by `part`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    rows = docs.select(column(id_col).cast("long").alias("key"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    shares = [(i + 1) / parts for i in range(parts - 1)]
    bounds = rows.select(F.percentile_approx("key", shares, max(10_000, 20 * parts)).alias("at")).first()["at"] if shares else []
    bounds = np.array(bounds or [], np.int64)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encoder.encode(part.column("text").to_pylist(), end_id)
                keys = pa.compute.fill_null(part.column("key"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, keys).astype(np.int32)), part.column("key"), packed.cast(pa.binary())], ["part", "key", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _SequenceFile | None = None
        done = []
        for batch in batches:
            part_of = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), len(part_of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if out is None or out.part != part_of[a]:
                        done += [out.close()] if out else []
                        out = _SequenceFile(folder, int(part_of[a]), length, kind, batch.schema.field("key").type)
                    out.add(batch.column("key").slice(a, b - a), [np.frombuffer(x, kind) for x in batch.column("ids").slice(a, b - a).to_pylist()])
        done += [out.close()] if out else []
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "file", "n_docs", "n_tokens", "n_sequences"])

    dealt = rows.mapInArrow(tokenize, "part int, key long, ids binary").repartitionById(parts, F.col("part"))
    return staged(dealt.sortWithinPartitions("part", F.col("key").asc_nulls_first(), "ids").mapInArrow(write, FILES))


def open_sequences(file: str) -> pa.ipc.RecordBatchFileReader:
    """A file of sequences, memory mapped where it is local."""
    system, path = _filesystem(file)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view, not a copy) and mask of row i."""
    batch = reader.get_batch(i // BATCH_ROWS)
    row = i % BATCH_ROWS
    length = batch.schema.field("input_ids").type.list_size
    ids = batch.column("input_ids").values.to_numpy(zero_copy_only=True)
    return ids[row * length : (row + 1) * length], batch.column("mask").values.slice(row * length, length).to_numpy(zero_copy_only=False)


def read_documents(files: DataFrame) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("part", "file", F.coalesce(before, F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                data = open_sequences(file)
                index = open_sequences(file + ".index")
                held, first, at = np.zeros(0, np.uint32), 0, 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    start, size = docs.column("start").to_numpy(), docs.column("length").to_numpy()
                    end = int(start[-1] + size[-1]) if len(start) else first
                    views = [held[int(start[0]) - first :] if len(start) else held]
                    first = int(start[0]) if len(start) else first
                    have = first + len(views[0])
                    while have < end:
                        values = data.get_batch(at).column("input_ids").values.to_numpy(zero_copy_only=True)
                        views.append(values.astype("<u4"))
                        have, at = have + len(values), at + 1
                    held = np.concatenate(views)
                    bounds = np.append(start, end).astype(np.int64) - first if len(start) else np.zeros(1, np.int64)
                    raw = held[: bounds[-1]].astype("<u4").tobytes()
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds * 4), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([docs.column("key"), pa.array(start + offset), docs.column("length"), ids], ["key", "start", "n_tokens", "ids"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(parts, F.pmod(F.col("part"), F.lit(parts))).mapInArrow(read, "key long, start long, n_tokens long, ids binary")


def crc32(ids: bytes) -> int:
    """The checksum of little-endian unsigned 32-bit ids, as Spark's crc32 gives it."""
    return zlib.crc32(ids)
