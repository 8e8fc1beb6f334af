"""The single clustering pass: the only work that runs in Python workers.

One call sees the rows of one bounded group, all with the same entity order and
the same non-empty contexts, and is a plain function of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

BUCKETS = 11
Vector = Sequence[tuple[str, float]]


def bucket(value: float) -> int:
    return int(np.floor(value * 10 + 0.5))


class Posting:
    """Clusters that hold one token, with the token's summed weight in each."""

    __slots__ = ("clusters", "weights", "slot", "used")

    def __init__(self) -> None:
        self.clusters = np.empty(4, dtype=np.int64)
        self.weights = np.empty(4)
        self.slot: dict[int, int] = {}
        self.used = 0

    def add(self, cluster: int, weight: float) -> float:
        """Add to a cluster's weight and return what it was before."""
        at = self.slot.get(cluster)
        if at is None:
            if self.used == len(self.clusters):
                self.clusters = np.concatenate([self.clusters, np.empty_like(self.clusters)])
                self.weights = np.concatenate([self.weights, np.empty_like(self.weights)])
            at = self.slot[cluster] = self.used
            self.clusters[at], self.weights[at] = cluster, 0.0
            self.used += 1
        before = self.weights[at]
        self.weights[at] = before + weight
        return float(before)


class ClusterPass:
    """Each item joins the most similar cluster above ``threshold``, or opens one.

    Cosines do not depend on length, so a cluster is kept as the running sum of
    its members. Of equally similar clusters the one opened first wins.
    """

    def __init__(self, threshold: float, plain_cosine: bool = False) -> None:
        self.threshold = threshold
        self.plain_cosine = plain_cosine
        self.postings: list[dict[str, Posting]] = [{}, {}, {}]
        self.norms = np.zeros((3, 16))
        self.sums: list[list[dict[str, float]]] = []
        self.sizes: list[int] = []
        self.histograms: list[np.ndarray] = []

    def open(self, vectors: Sequence[Vector], size: int, copies: int = 1) -> int:
        cluster = len(self.sums)
        if cluster == self.norms.shape[1]:
            self.norms = np.concatenate([self.norms, np.zeros_like(self.norms)], axis=1)
        self.sums.append([{}, {}, {}])
        self.sizes.append(0)
        self.histograms.append(np.zeros(BUCKETS, dtype=np.int64))
        self.extend(cluster, vectors, size, copies)
        return cluster

    def extend(self, cluster: int, vectors: Sequence[Vector], size: int, copies: int = 1) -> None:
        """Add ``copies`` equal members of ``size`` each."""
        for part, vector in enumerate(vectors):
            sums, postings = self.sums[cluster][part], self.postings[part]
            for token, weight in vector:
                posting = postings.get(token)
                if posting is None:
                    posting = postings[token] = Posting()
                before = posting.add(cluster, weight * copies)
                after = before + weight * copies
                sums[token] = after
                self.norms[part, cluster] += after * after - before * before
        self.sizes[cluster] += size * copies

    def similarities(self, vectors: Sequence[Vector]) -> np.ndarray:
        count = len(self.sums)
        total = np.zeros(count)
        for part, vector in enumerate(vectors):
            if not vector:
                continue
            dots, shared = np.zeros(count), np.zeros(count)
            for token, weight in vector:
                posting = self.postings[part].get(token)
                if posting is not None:
                    clusters, weights = posting.clusters[: posting.used], posting.weights[: posting.used]
                    dots[clusters] += weight * weights
                    if part == 2 and not self.plain_cosine:
                        shared[clusters] += weights * weights
            own = sum(weight * weight for _, weight in vector)
            total += dots / (np.sqrt(self.norms[part, :count] + shared) * np.sqrt(own))
        return total / 3

    def joining_similarity(self, cluster: int, vectors: Sequence[Vector], added: int) -> float:
        """Similarity of an item with a cluster that has taken in ``added`` copies of it already."""
        total = 0.0
        for part, vector in enumerate(vectors):
            if not vector:
                continue
            sums = self.sums[cluster][part]
            own = sum(w * w for _, w in vector)
            dot = sum(w * sums.get(t, 0.0) for t, w in vector) + added * own
            norm = self.norms[part, cluster]
            for token, weight in vector:
                before = sums.get(token, 0.0)
                after = before + added * weight
                norm += after * after - before * before
                if part == 2 and not self.plain_cosine:
                    norm += after * after
            total += dot / (np.sqrt(norm) * np.sqrt(own))
        return total / 3

    def _count_copies(self, cluster: int, vectors: Sequence[Vector], first: int, last: int) -> None:
        """Histogram of the copies ``first..last``: each only gets more similar, so buckets are runs."""
        while first <= last:
            current = bucket(self.joining_similarity(cluster, vectors, first))
            low, high = first, last
            while low < high:
                middle = (low + high + 1) // 2
                if bucket(self.joining_similarity(cluster, vectors, middle)) > current:
                    high = middle - 1
                else:
                    low = middle
            self.histograms[cluster][min(current, BUCKETS - 1)] += low - first + 1
            first = low + 1

    def add(self, vectors: Sequence[Vector], size: int = 1, copies: int = 1, count: bool = False) -> int:
        """Place ``copies`` equal items of ``size`` each; returns the cluster they end up in.

        A copy follows the one before it: joining a cluster makes that cluster
        more similar to the item and leaves the others as they were.
        """
        if self.sums:
            scores = self.similarities(vectors)
            best = int(np.argmax(scores))
            if scores[best] > self.threshold:
                if count:
                    self._count_copies(best, vectors, 0, copies - 1)
                self.extend(best, vectors, size, copies)
                return best
            best_score = float(scores[best])
        else:
            best_score = None
        cluster = self.open(vectors, size)
        if count and best_score is not None:
            self.histograms[cluster][bucket(max(best_score, 0.0))] += 1
        if copies > 1:
            if count:
                self._count_copies(cluster, vectors, 0, copies - 2)
            self.extend(cluster, vectors, size, copies - 1)
        return cluster

    def sum_vectors(self, cluster: int) -> list[list[dict]]:
        """The three summed vectors as sorted ``token, weight`` records."""
        return [
            [{"token": t, "weight": float(w)} for t, w in sorted(part.items(), key=lambda e: e[0].encode())]
            for part in self.sums[cluster]
        ]

    def centroid(self, cluster: int) -> list[list[dict]]:
        """The three vectors scaled to a total of one each."""
        scaled = []
        for part in self.sum_vectors(cluster):
            total = sum(x["weight"] for x in part)
            scaled.append([{"token": x["token"], "weight": x["weight"] / total} for x in part])
        return scaled


def as_vectors(rows: Iterable[Iterable]) -> tuple[list[tuple[str, float]], ...]:
    """Arrow-delivered contexts as ``(token, weight)`` pairs."""
    return tuple([(x["token"], x["weight"]) for x in part] for part in rows)


def sort_key(vectors: Sequence[Vector]) -> tuple:
    """Total order of contexts, the same as the SQL order of the arrays."""
    return tuple(tuple((t.encode(), w) for t, w in part) for part in vectors)
