"""Sentences of many texts at a time: what ``functions.tagged`` says of a text, for the texts of an Arrow batch.

Words are looked at once a batch, however often they occur.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pairloom.functions.tagged import _EDGE, _INNER

# As in Spark, where ``$`` stands before a last line end of any kind, too; those at which words are cut are in no word.
_END = "(?=[\u0085\u2028\u2029]?\\Z)"
_DOTTED = re.compile(r"[(\"\[']*([A-Za-z]+(?:[.'-][A-Za-z]+)*)(\.?)[,;:)\]\"']*" + _END)
_LAST_STOP = re.compile(r"\.(?=[,;:)\]\"']*" + _END + ")")
# Line by line the replacements of ``tagged.single_spaced`` after white space, and the cuts of ``tagged.sentence_list``.
_SPACED = [(r'([!?;()"\[\]])', r" \1 "), (r"([.,:]+)( |\z)", r" \1 "), (" +", " ")]
_CUT = (r"((?: [.!?]+)+(?: [)\]])*) ", rf"\1{_EDGE}")


def _replaced(texts: pa.Array, pattern: str, by: str) -> pa.Array:
    return pa.compute.replace_substring_regex(texts, pattern, by)


def one_spaced(texts: pa.Array) -> pa.Array:
    """Texts without control characters of ours, with one space for white space."""
    for mark in (_EDGE, _INNER):
        texts = pa.compute.replace_substring(texts, mark, "")
    return _replaced(texts, "[ \t\n\r\f]+", " ")


def word_parts(word: str) -> tuple[str, bool]:
    """``tagged.bare`` and ``tagged.with_full_stop`` of a word."""
    found = _DOTTED.match(word)
    return (found[1].lower(), found[2] == ".") if found else ("", False)


def count_words(texts: pa.Array) -> dict[str, list[int]]:
    """Of each bare word of the texts, none of which is null, how often it is there and how often before a full stop."""
    known = pa.compute.split_pattern(one_spaced(texts), " ").flatten().dictionary_encode()
    counts: dict[str, list[int]] = {}
    times = np.bincount(known.indices.to_numpy(), minlength=len(known.dictionary)).tolist()
    for word, n in zip(known.dictionary.to_pylist(), times, strict=True):
        name, stop = word_parts(word)
        if name:
            held = counts.setdefault(name, [0, 0])
            held[0] += n
            held[1] += n * stop
    return counts


def _with_inner_stops(texts: pa.Array, abbreviations: Collection[str]) -> pa.Array:
    """Texts of :func:`one_spaced` with a mark for the full stops of abbreviations."""
    words = pa.compute.split_pattern(texts, " ")
    known = words.flatten().dictionary_encode()

    def marked(word: str) -> str:
        name, stop = word_parts(word)
        return _LAST_STOP.sub(_INNER, word) if stop and name in abbreviations else word

    dictionary = pa.array([marked(w) if "." in w else w for w in known.dictionary.to_pylist()], pa.string())
    return pa.compute.binary_join(pa.ListArray.from_arrays(words.offsets, dictionary.take(known.indices)), " ")


def cut_sentences(texts: pa.Array, abbreviations: Collection[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The sentences of texts, none of which is null, with the row and the place in it of each, as ``tagged.sentence_list`` has them."""
    marked = _with_inner_stops(one_spaced(texts), abbreviations)
    for pattern, by in _SPACED:
        marked = _replaced(marked, pattern, by)
    marked = _replaced(pa.compute.utf8_trim(marked, characters=" "), *_CUT)
    pieces = pa.compute.split_pattern(pa.compute.replace_substring(marked, _INNER, "."), _EDGE)
    row = np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy())
    flat = pieces.flatten()
    some = pa.compute.not_equal(flat, "")
    row = row[np.asarray(some)]
    first = np.searchsorted(row, row, "left")
    return row, np.arange(len(row)) - first, flat.filter(some)
