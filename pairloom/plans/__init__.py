"""Whole jobs composed of the operators."""

from pairloom.plans.bootstrap import Corpus, Extraction, Round, bootstrap_relations, prepare_mentions
from pairloom.plans.jobs import article_statistics, extract_relations, tag_articles, tag_in_context, tag_parts_of_speech, word_statistics

__all__ = [
    "Corpus",
    "Extraction",
    "Round",
    "article_statistics",
    "bootstrap_relations",
    "extract_relations",
    "prepare_mentions",
    "tag_articles",
    "tag_in_context",
    "tag_parts_of_speech",
    "word_statistics",
]
