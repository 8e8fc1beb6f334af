"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of words. A word has two kinds of input: one of the word itself (how much more often toxic texts
hold it) and those of its characters (the same for its byte trigrams: mean and highest), so unseen spellings count too. Gated
recurrent units read a window in both directions, attention pools their states, and a logistic unit scores the window. A document's
score is that of its highest window, calibrated on the training documents. All windows of whole texts are scored.

Learning uses a bounded sample of the labelled rows: at most `per_label` of each label, by the order of a hash of their keys, and one
text (the smallest) of each key.

Defined results: a null or empty text is scored as a window without words; null labels or keys teach nothing; without rows of both
labels every score is 0; repeated rows are scored each; equal texts have equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ALPHANUMERIC, LOWERED, column, slices, text_bytes, word_hashes, words

#: Words of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 48, 36
HIDDEN, INPUTS = 6, 4
#: Windows that the network reads at a time, and entries of the trigram table.
BATCH, TRIGRAMS = 2048, 1 << 16
#: Words that the model knows, those that say most.
VOCABULARY = 50_000


@dataclass(frozen=True)
class Texts:
    """Word numbers of all texts, the inputs of the different words, and where each text's words start."""

    number: np.ndarray
    codes: np.ndarray
    trigrams: np.ndarray
    trigram_of: np.ndarray
    first: np.ndarray


def read(texts: pa.Array) -> Texts:
    data, at = text_bytes(texts)
    lowered = LOWERED[data]
    starts, ends, first = words(lowered, at, ALPHANUMERIC)
    codes, example, number = np.unique(word_hashes(lowered, starts, ends), return_index=True, return_inverse=True)
    begin, length = starts[example], (ends - starts)[example]
    owner = np.repeat(np.arange(len(codes)), length)
    offset = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    place = begin[owner] + offset
    padded = np.concatenate([[0], lowered.astype(np.int64), [0]]) if len(lowered) else np.zeros(2, np.int64)
    before = np.where(offset == 0, 0, padded[place])
    after = np.where(offset == length[owner] - 1, 0, padded[np.minimum(place + 2, len(padded) - 1)])
    trigrams = (before * 961_748_941 + padded[place + 1] * 982_451_653 + after * 899_809_363) >> 5 & (TRIGRAMS - 1)
    return Texts(number.ravel(), codes, trigrams, np.cumsum(length) - length, first)


@dataclass(frozen=True)
class Lexicon:
    """How much more often toxic texts hold a word or a trigram (cautious log odds)."""

    codes: np.ndarray
    odds: np.ndarray
    trigram_odds: np.ndarray

    def inputs(self, texts: Texts) -> np.ndarray:
        """Inputs of each different word."""
        out = np.zeros((len(texts.codes), INPUTS), np.float32)
        if len(texts.codes):
            if len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, texts.codes), len(self.codes) - 1)
                known = self.codes[at] == texts.codes
                out[:, 0] = np.where(known, self.odds[at], 0)
                out[:, 1] = known
            values = self.trigram_odds[texts.trigrams]
            size = np.diff(np.append(texts.trigram_of, len(values)))
            out[:, 2] = np.add.reduceat(values, texts.trigram_of) / size
            out[:, 3] = np.maximum.reduceat(values, texts.trigram_of)
        return out


def _cautious(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.sign(odds) * np.maximum(np.abs(odds) - error, 0)


def lexicon(texts: Texts, labels: np.ndarray) -> Lexicon:
    doc = np.repeat(np.arange(len(labels)), np.diff(texts.first))
    pairs = np.unique(doc * len(texts.codes) + texts.number)
    counts = [np.bincount(pairs[labels[pairs // max(len(texts.codes), 1)] == k] % max(len(texts.codes), 1), minlength=len(texts.codes)) for k in (1, 0)]
    n = int(labels.sum()), int((1 - labels).sum())
    odds = _cautious(*counts, *n)
    best = np.sort(np.argsort(-np.abs(odds), kind="stable")[:VOCABULARY])
    best = best[odds[best] != 0]
    size = np.diff(np.append(texts.trigram_of, len(texts.trigrams)))
    by_word = np.repeat(np.arange(len(texts.codes)), size)
    grams = [np.bincount(texts.trigrams, np.minimum(c, 50)[by_word], minlength=TRIGRAMS) for c in counts]
    share = [max(g.sum(), 1) for g in grams]
    return Lexicon(texts.codes[best], odds[best].astype(np.float32), _cautious(*grams, *map(int, share)).astype(np.float32))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, words and text of all windows; a text without words has one window without words."""
    count = np.diff(first)
    each = np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(count)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return first[:-1][text] + k * STRIDE, np.minimum(count[text] - k * STRIDE, WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters and their passes. Arrays are steps x windows x units."""

    def __init__(self, seed: int = 3):
        chance = np.random.default_rng(seed)
        draw = lambda *shape: (chance.normal(0, 0.4, shape)).astype(np.float32)
        self.p = {f"{k}_{d}": v for d in "fb" for k, v in (("w", draw(INPUTS, 3 * HIDDEN)), ("u", draw(HIDDEN, 3 * HIDDEN)), ("c", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}

    def _direction(self, gates: np.ndarray, mask: np.ndarray, d: str, kept: list | None) -> np.ndarray:
        """gates: the inputs' part of the gates, in the order of reading."""
        u, states = self.p[f"u_{d}"], np.zeros((*gates.shape[:2], HIDDEN), np.float32)
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        for t in range(len(gates)):
            back = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if kept is not None:
                kept.append((h, z, r, n, back[:, 2 * HIDDEN :]))
            h = np.where(mask[t][:, None], new, h)
            states[t] = h
        return states

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = np.where(mask, states @ self.p["attend"], -1e9)
        weight = np.exp(weight - weight.max(0)) * mask
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return weight, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, by_word: list[np.ndarray], number: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """by_word: the inputs' part of the gates of each different word, forwards and backwards."""
        steps = np.arange(int(max(length.max(initial=0), 1)))[:, None]
        mask = steps < length
        place = np.where(mask, start + steps, 0)
        rows = number[place] if len(number) else np.zeros(place.shape, np.int64)
        states = [self._direction(by_word[0][rows], mask, "f", None), self._direction(by_word[1][rows[::-1]], mask[::-1], "b", None)[::-1]]
        return self._pool(np.concatenate(states, 2), mask)[2]

    def gates(self, inputs: np.ndarray) -> list[np.ndarray]:
        if not len(inputs):
            inputs = np.zeros((1, INPUTS), np.float32)
        return [inputs @ self.p[f"w_{d}"] + self.p[f"c_{d}"] for d in "fb"]

    def step(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of a batch."""
        kept: dict[str, list] = {"f": [], "b": []}
        order = {"f": slice(None), "b": slice(None, None, -1)}
        states = np.concatenate([self._direction(x[order[d]] @ self.p[f"w_{d}"] + self.p[f"c_{d}"], mask[order[d]], d, kept[d])[order[d]] for d in "fb"], 2)
        weight, pooled, logit = self._pool(states, mask)
        error = ((_sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        grads = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        to_pooled = error[:, None] * self.p["out"]
        to_weight = np.einsum("tbh,bh->tb", states, to_pooled)
        to_score = weight * (to_weight - (weight * to_weight).sum(0))
        grads["attend"] = np.einsum("tb,tbh->h", to_score, states)
        to_states = weight[:, :, None] * to_pooled + to_score[:, :, None] * self.p["attend"]
        for i, d in enumerate("fb"):
            wanted = to_states[order[d]][:, :, i * HIDDEN : (i + 1) * HIDDEN]
            inputs, seen = x[order[d]], mask[order[d]]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dw, du, dc = (np.zeros_like(self.p[f"{k}_{d}"]) for k in "wuc")
            for t in range(len(x) - 1, -1, -1):
                h, z, r, n, back = kept[d][t]
                dh = dh + wanted[t]
                new = np.where(seen[t][:, None], dh, 0)
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (h - n) * z * (1 - z)
                dr = dn * back * r * (1 - r)
                to_gates = np.concatenate([dz, dr, dn], 1)
                to_back = np.concatenate([dz, dr, dn * r], 1)
                dw += inputs[t].T @ to_gates
                dc += to_gates.sum(0)
                du += h.T @ to_back
                dh = np.where(seen[t][:, None], new * z, dh) + to_back @ self.p[f"u_{d}"].T
            grads |= {f"w_{d}": dw, f"u_{d}": du, f"c_{d}": dc}
        return grads

    def train(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray, passes: int, seed: int = 11) -> None:
        chance, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(passes):
            order = chance.permutation(len(labels))
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                t += 1
                for k, g in self.step(x[:, rows], mask[:, rows], labels[rows], weights[rows]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    network: Network
    slope: float
    shift: float

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Logit of the highest window of each text."""
        held = read(texts)
        gates = self.network.gates(self.lexicon.inputs(held))
        start, length, text = windows(held.first)
        found = np.zeros(len(start))
        order = np.argsort(length, kind="stable")  # short windows together take few steps
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            found[rows] = self.network.logits(gates, held.number, start[rows], length[rows])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, found)
        return best

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return _sigmoid(np.clip(self.slope * self.raw(texts) + self.shift, -30, 30))


def train_model(texts: list[str], labels: np.ndarray, passes: int = 12) -> ToxicityModel | None:
    """From texts and labels (0 or 1); None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    array = pa.array(texts, pa.large_string())
    held = read(array)
    # the inputs of half of the texts are learned from the other half, so that the network sees them as they are on new texts
    half = np.random.default_rng(2).permutation(len(labels)) % 2
    network = Network()
    xs, masks, ys, ws = [], [], [], []
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        if len(set(labels[other].tolist())) < 2:
            other = np.arange(len(labels))
        known = lexicon(read(array.take(pa.array(other))), labels[other])
        part = read(array.take(pa.array(own)))
        inputs = known.inputs(part)
        start, length, text = windows(part.first)
        gathered = np.concatenate([[0], np.cumsum(np.maximum(inputs[part.number, 0], 0) ** 2)]) if len(part.number) else np.zeros(1)
        strength = gathered[start + length] - gathered[start]
        # the window that says most stands for its text, and some other windows of clean texts besides
        order = np.lexsort((-strength, text))
        chosen = order[np.append(True, text[order][1:] != text[order][:-1])]
        clean = np.flatnonzero(labels[own][text] == 0)
        chosen = np.concatenate([chosen, clean[:: max(1, len(clean) // max(len(own), 1))]])
        steps = np.arange(WINDOW)[:, None]
        mask = steps < length[chosen]
        rows = part.number[np.where(mask, start[chosen] + steps, 0)] if len(part.number) else np.zeros(mask.shape, np.int64)
        xs.append((inputs[rows] if len(inputs) else np.zeros((*mask.shape, INPUTS), np.float32)) * mask[:, :, None])
        masks.append(mask)
        ys.append(labels[own][text[chosen]])
    x, mask, y = np.concatenate(xs, 1).astype(np.float32), np.concatenate(masks, 1), np.concatenate(ys).astype(np.float32)
    ws = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    network.train(x, mask, y, ws, passes)
    model = ToxicityModel(lexicon(held, labels), network, 1.0, 0.0)
    raw = np.concatenate([model.raw(array.slice(at, 500)) for at in range(0, len(array), 500)])
    # calibration: a logistic curve over the training documents' highest windows
    slope, shift = 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(np.clip(slope * raw + shift, -30, 30))
        g = np.array([((p - labels) * raw).sum() + 1e-2 * slope, (p - labels).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum()]])
        change = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(change[0], -1, 1)), shift - float(np.clip(change[1], -2, 2))
    return ToxicityModel(model.lexicon, network, max(slope, 1e-3), shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2500) -> ToxicityModel | None:
    """Learn from at most `per_label` rows of each label for which `train` (over the key, named `key`) is true."""
    known = labels.select(column(id_col).alias("key"), column(label_col).cast("int").alias("label")).where(train & F.col("label").isin(0, 1) & F.col("key").isNotNull())
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(per_label)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(column(id_col).alias("key"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "key").select(F.col("key").cast("string").alias("key"), "text", "label")
    rows = rows.groupBy("key").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "label")), strict=True))
        model = train_model([t for _, t, _ in held], np.array([y for *_, y in held], np.int64)) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the sample is bounded, so one task can learn from it; the driver only gets the model
    learned = rows.repartition(1).mapInArrow(train_all, "model binary").first()
    return pickle.loads(learned["model"]) if learned else None


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and score (0 to 1) of every row."""
    kind = docs.select(column(id_col)).dtypes[0][1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                scores = shared.value.score(texts) if shared.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores, pa.float64())], ["key", "score"])

    rows = docs.select(column(id_col).alias("key"), column(text_col).alias("text"))
    return rows.mapInArrow(score, f"key {kind}, score double").select(F.col("key").alias(id_col), "score")
