"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A text becomes a few bounded statistics (symbols, capitals, repetition, word lengths, lines). Random Fourier features approximate a
Gaussian kernel over the standardized statistics. Each partition sums its share of the normal equations, Spark adds the shares up, and
the driver solves one small system. Isotonic regression over score bins of all training rows turns ridge scores into probabilities.

Defined results: a null text is an empty one; a null label or null key trains nothing; of several labels of a key the highest counts;
without any label every score is 1.0 (nothing is known against a text); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import LOWERED, column, slices, staged, text_bytes, word_hashes, words

#: Classes of bytes: other, lower case, upper case, digit, space or tab, line end, full stop or comma, other symbols.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]], _KIND[[46, 44]] = 1, 2, 3, 4, 5, 6
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x not in (46, 44)]] = 7
STATISTICS = 18


@dataclass(frozen=True)
class QualityModel:
    """Means and deviations of the statistics, the random features, ridge weights, and the calibration curve."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return fourier(self, statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(statistics), self.knots, self.levels)


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text, each within fixed bounds or logarithmic."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    size = np.diff(at)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
    lowered = LOWERED[data]
    starts, ends, first = words(lowered, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    codes = word_hashes(lowered, starts, ends)
    many = np.maximum(count, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, minlength=n) / many

    symbol = np.isin(_KIND[data[ends - 1]], (7,)) if len(ends) else np.zeros(0, bool)
    capital = (_KIND[data[starts]] == 2) if len(starts) else symbol
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    stop = (_KIND[data[ends - 1]] == 6) if len(ends) else symbol
    order = np.lexsort((codes, owner))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], fresh, minlength=n)
    mean = per_word(length)
    shares = kinds / np.maximum(size, 1)[:, None]
    return np.column_stack(
        [
            np.log1p(count),
            np.minimum(mean, 30),
            np.minimum(np.sqrt(np.maximum(per_word(np.minimum(length, 1000.0) ** 2) - mean**2, 0)), 30),
            per_word(symbol),
            per_word(capital),
            per_word(same),
            per_word(stop),
            per_word(length <= 3),
            np.log1p(distinct) - np.log1p(count),
            np.log1p(count) - np.log1p(kinds[:, 5]),
            np.sqrt(shares),
        ]
    )


def fourier(model: QualityModel, statistics: np.ndarray) -> np.ndarray:
    """A constant and the random Fourier features."""
    scaled = np.clip((statistics - model.mean) / model.deviation, -8, 8)
    z = np.cos(scaled @ model.directions + model.shifts) * np.sqrt(2 / len(model.shifts))
    return np.column_stack([np.ones(len(z)), z])


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Levels that never fall and are nearest to the bins' means (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.repeat([s / n for s, n, _ in blocks], [int(k) for *_, k in blocks])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    features: int = 160,
    ridge: float = 1e-4,
    bins: int = 400,
    seed: int = 7,
) -> QualityModel:
    """Learn from every labelled row for which `train` (over the key, named `key`) is true.

    The driver gets per-statistic moments, `features`² / 2 sums, and at most `bins` score bins, whatever the number of rows.
    """
    known = labels.select(column(id_col).alias("key"), column(label_col).cast("double").alias("label")).where(train & F.col("label").isNotNull() & F.col("key").isNotNull())
    known = known.groupBy("key").agg(F.max("label").alias("label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = text_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(rows), pa.list_(pa.float64()))], ["key", "x"])

    texts = docs.select(column(id_col).alias("key"), column(text_col).alias("text")).where(train & F.col("key").isNotNull())
    key_type = docs.select(column(id_col)).dtypes[0][1]
    rows = staged(texts.mapInArrow(measure, f"key {key_type}, x array<double>").join(known, "key").select("x", "label"))
    moments = {r["i"]: r for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    chance = np.random.default_rng(seed)
    if not moments:
        zero = np.zeros(STATISTICS)
        return QualityModel(zero, zero + 1, np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.ones(1))
    mean = np.array([moments[i]["m"] for i in range(STATISTICS)])
    deviation = np.array([moments[i]["s"] for i in range(STATISTICS)]) + 1e-3
    directions = chance.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, features))
    blank = QualityModel(mean, deviation, directions, chance.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.ones(1))
    upper = np.triu_indices(features + 2)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 2, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([fourier(blank, np.stack(batch.column("x").to_numpy(zero_copy_only=False))), batch.column("label").to_numpy()])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["cell", "v"])

    sums = rows.mapInArrow(equations, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    system = np.zeros((features + 2, features + 2))
    for cell, v in sums:
        system[upper[0][cell], upper[1][cell]] = system[upper[1][cell], upper[0][cell]] = v
    n = moments[0]["n"]
    penalty = np.eye(features + 1) * (ridge * n + 0.02)
    penalty[0, 0] = 1e-9 * n
    weights = np.linalg.solve(system[:-1, :-1] + penalty, system[:-1, -1])
    fitted = QualityModel(mean, deviation, directions, blank.shifts, weights, np.zeros(1), np.ones(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = fitted.raw(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
                at = np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["bin", "label"])

    table = sorted(rows.mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("s"), F.count("label").alias("n")).collect())
    share = sum(r["s"] for r in table) / n
    levels = isotonic(np.array([r["s"] + share * 0.5 for r in table]), np.array([r["n"] + 0.5 for r in table]))
    knots = np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in table])
    return QualityModel(mean, deviation, directions, blank.shifts, weights, knots, np.clip(levels, 0, 1))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and score (0 to 1) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(model.score(text_statistics(part.column("text"))))], ["key", "score"])

    kind = docs.select(column(id_col)).dtypes[0][1]
    texts = docs.select(column(id_col).alias("key"), column(text_col).alias("text"))
    return texts.mapInArrow(score, f"key {kind}, score double").select(F.col("key").alias(id_col), "score")


def keep_quality(docs: DataFrame, model: QualityModel, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches `least`."""
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in slices(named, str(place)):
                kept = part.filter(pa.array(model.score(text_statistics(part.column(place))) >= least))
                yield kept.rename_columns(batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)
