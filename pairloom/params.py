"""Settings shared by every operator."""

from __future__ import annotations

import re
from dataclasses import dataclass

SQRT_HALF = 0.5**0.5


@dataclass(frozen=True)
class Params:
    """Extraction settings; the defaults are the published experiment values.

    ``plain_cosine`` replaces the damped right-hand score by a textbook cosine.
    ``cluster_mode`` is ``"two_level"`` (single pass per bucket, then merges of
    alike clusters of all buckets) or ``"exact"`` (level 1 only groups equal
    contexts). A group has ``buckets`` level-1 buckets by the middle context,
    times ``side_buckets`` by the other two. Both are part of the meaning:
    results depend on the rows and the settings, not on the number of rows.
    Larger corpora need more buckets to keep tasks small.
    """

    window_size: int = 5
    max_distance: int = 5
    similarity_threshold: float = 0.4
    degree_of_match_threshold: float = 0.6
    minimal_cluster_size: int = 5
    tuple_confidence_threshold: float = 0.9
    iterations: int = 1
    entity_tags: tuple[str, str] = ("ORGANIZATION", "LOCATION")
    plain_cosine: bool = False
    dedup_seeds: bool = False
    early_stop: bool = False
    cluster_mode: str = "two_level"
    buckets: int = 16
    side_buckets: int = 4

    def __post_init__(self) -> None:
        if self.degree_of_match_threshold <= 0 or self.similarity_threshold <= 0:
            raise ValueError("similarity thresholds must be positive")
        if self.window_size < 0 or self.max_distance < 1 or min(self.buckets, self.side_buckets) < 1:
            raise ValueError("window_size, max_distance, buckets and side_buckets must be positive")
        if self.cluster_mode not in ("two_level", "exact"):
            raise ValueError(f"unknown cluster_mode {self.cluster_mode!r}")
        if self.entity_tags[0] == self.entity_tags[1] or not all(re.fullmatch("[A-Z]+", t) for t in self.entity_tags):
            raise ValueError("the two entity tags must differ and be of capital letters")

    def part_ceilings(self) -> tuple[float, float, float]:
        """Greatest score the left, middle and right context can each reach."""
        return (1.0, 1.0, 1.0 if self.plain_cosine else SQRT_HALF)

    def self_similarity(self, signature: int) -> float:
        """Similarity of a context with an equal one; also the greatest any pair can reach."""
        left, middle, right = self.part_ceilings()
        parts = (left if signature & 4 else 0.0, middle if signature & 2 else 0.0, right if signature & 1 else 0.0)
        return sum(parts) / 3

    def joinable_signatures(self) -> list[int]:
        """Signatures whose contexts can join a cluster at all."""
        return [s for s in range(8) if self.self_similarity(s) > self.similarity_threshold]
