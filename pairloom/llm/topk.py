"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of equal row counts; queries travel in blocks. The bucket of the longest vectors gives
every query a first threshold. For each other bucket the threshold and the two lengths give a local cosine threshold: above 1 the
bucket is left out; near 1 a coordinate is chosen and only vectors within its feasible range are looked at; below, only vectors that
are long enough. What remains is verified by exact integer products.

Defined results: a vector that is null, or holds null or non-finite components, takes no part; vectors of other dimensions never meet;
a row with the query's own id is the query's own; repeated rows count each as candidates, but as a query once, and queries of one id with
different vectors have ranks of their own; ties go to the smaller id. Scores must fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import column, staged

BUCKET_ROWS, BLOCK_ROWS = 2048, 512
#: Local cosine thresholds from which coordinates prune better than lengths.
NEAR = 0.6
_SLACK = 1e-9
_PACK = "pack long, dim int, longest double, ids binary, norms binary, matrix binary"


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, norm and components floor(scale * x) of the vectors that take part."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("id").to_pylist(), []
            for key, x in zip(ids, batch.column("x"), strict=True):
                values = None if x.as_py() is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if key is not None and values is not None and np.isfinite(values).all():
                    whole = np.floor(scale * values).astype(np.int64)
                    out.append((key, len(whole), float(np.sqrt((whole.astype(np.float64) ** 2).sum())), whole.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["id", "dim", "norm", "v"])

    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(convert, "id long, dim int, norm double, v binary")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension, sorted from long to short."""
    order = [F.col("dim"), F.col("norm").desc(), F.col("id")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, []

        def block() -> pa.RecordBatch:
            ids, dims, norms, vs = zip(*held, strict=True)
            row = [(TaskContext.get().partitionId() << 32) + made], [dims[0]], [max(norms)], [np.array(ids, np.int64).tobytes()], [np.array(norms).tobytes()], [b"".join(vs)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["pack", "dim", "longest", "ids", "norms", "matrix"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "norm", "v")), strict=True):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield block()
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield block()

    return staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, _PACK))


def _candidates(q: np.ndarray, length: float, least: float, matrix: np.ndarray, norms: np.ndarray, ranges: dict) -> np.ndarray | slice:
    """Rows of a bucket that can reach `least` with the query."""
    if least <= 0 or not length:
        return slice(0, len(norms)) if least <= 0 else slice(0, 0)
    cosine = least / (length * norms[0]) if norms[0] else np.inf
    if cosine > 1 + _SLACK:
        return slice(0, 0)
    long_enough = int(np.searchsorted(-norms, -(least / length) * (1 - _SLACK), "right"))
    if cosine < NEAR:
        return slice(0, long_enough)
    focus = int(np.argmax(np.abs(q)))
    if focus not in ranges:
        unit = matrix[:, focus] / np.maximum(norms, 1e-300)
        order = np.argsort(unit)
        ranges[focus] = order, unit[order]
    order, sorted_units = ranges[focus]
    part, cosine = q[focus] / length, min(cosine, 1.0)
    around = np.sqrt(max(0.0, (1 - cosine**2) * (1 - part**2))) + 1e-7
    # with the cosine at least `cosine`, a unit vector's coordinate is within this range (the ends hold 1 beyond the query's own)
    low = -1.0 if part <= -cosine else part * cosine - around
    high = 1.0 if part >= cosine else part * cosine + around
    within = order[np.searchsorted(sorted_units, low, "left") : np.searchsorted(sorted_units, high, "right")]
    return within[within < long_enough] if len(within) < long_enough else slice(0, long_enough)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        close = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return close[np.lexsort((ids[close], -scores[close]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dim"]
            ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float64)
            matrix = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), d)
            q_ids, q_norms = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_norms"], np.float64)
            queries = np.frombuffer(row["q_matrix"], np.int64).reshape(len(q_ids), d)
            least = np.frombuffer(row["least"], np.float64) if row["least"] is not None else np.full(len(q_ids), -np.inf)
            exact = d * float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2.0**52
            kind = np.float64 if exact else np.int64  # products in doubles are exact there, and much faster
            left, right, ranges = matrix.astype(kind), queries.astype(kind), {}
            found: list[tuple[np.ndarray, ...]] = []
            for j in range(len(q_ids)):
                rows = _candidates(queries[j], q_norms[j], least[j], matrix, norms, ranges)
                near = ids[rows]
                scores = left[rows] @ right[j]
                keep = (near != q_ids[j]) & (scores >= least[j])
                near, scores = near[keep], scores[keep]
                top = _best(scores, near, k)
                found.append((np.full(len(top), j), np.full(len(top), q_ids[j]), near[top], scores[top].astype(np.int64)))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), row["block"])), *map(pa.array, columns)], ["block", "query", "query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query (is_query is over the column `id`)."""
    rows = staged(integer_vectors(vectors, scale, id_col, vector_col))
    buckets = packed(rows, BUCKET_ROWS)
    asked = packed(rows.where(is_query).dropDuplicates(["id", "v"]), BLOCK_ROWS).select(F.col("pack").alias("block"), F.col("dim").alias("q_dim"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("norms").alias("q_norms"), F.col("matrix").alias("q_matrix"))
    # every block of queries meets every bucket of its dimension that its thresholds allow; only numbers of both are joined here,
    # spread over salts because all may have one dimension
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = buckets.select("pack", "dim", "longest", F.pmod(F.hash("pack"), F.lit(salts)).alias("salt"))
    blocks = asked.select("block", "q_dim", "q_longest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q_salt"))
    pairs = blocks.join(names, (F.col("q_dim") == F.col("dim")) & (F.col("q_salt") == F.col("salt"))).select("block", "q_longest", "pack", "longest")
    first = pairs.groupBy("block").agg(F.max_by("pack", F.struct("longest", "pack")).alias("pack"))

    def search(chosen: DataFrame) -> DataFrame:
        met = chosen.join(asked, "block").join(buckets, "pack")
        met = met.select("block", "dim", "ids", "norms", "matrix", "q_ids", "q_norms", "q_matrix", "least")
        return met.mapInArrow(lambda batches: _search(batches, k), "block long, query long, query_id long, vec_id long, score long")

    start = staged(search(first.withColumn("least", F.lit(None).cast("binary"))))
    ranked = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score")))
    kth = start.withColumn("at", ranked).where(F.col("at") == k).select("block", "query", F.col("score").cast("double").alias("least"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                known = dict(row["known"] or [])
                least = np.array([known.get(j, -np.inf) for j in range(len(row["q_ids"]) // 8)])
                out.append((row["block"], float(least.min(initial=np.inf)), least.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.binary()), strict=True)], ["block", "lowest", "least"])

    # at most BLOCK_ROWS thresholds gather in a row
    by_block = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "least"))).alias("known"))
    limits = staged(asked.select("block", "q_ids").join(by_block, "block", "left").mapInArrow(thresholds, "block long, lowest double, least binary"))
    open_pairs = pairs.join(first.withColumnRenamed("pack", "done"), "block").where(F.col("pack") != F.col("done")).join(limits, "block")
    open_pairs = open_pairs.where(F.col("longest") * F.col("q_longest") * (1 + _SLACK) >= F.col("lowest")).select("block", "pack", "least")
    found = start.unionByName(search(open_pairs))
    rank = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
