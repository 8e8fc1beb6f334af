"""Grow a table of entity pairs from text and a few known examples, on Spark."""

from pairloom.params import Params

__all__ = ["Params"]
