"""Sentences of a batch cut into contexts at once, by Arrow and numpy: the same windows as :func:`pairloom.operators.segments.context_windows`.

Works on whole batches: one regular expression and two splits give all tokens, tokens become numbers in the order of their bytes, and
windows are ranges of these numbers. Only sentences whose organization markers do not pair off are looked at one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a dot does not match in the expressions of the engine.
_LINE_ENDS = "\n\r\u0085\u2028\u2029"
_ENTITY = f"<([A-Z]+)>([^{_LINE_ENDS}]+?)</([A-Z]+)>"

WINDOW_COLUMNS = ["org", "loc", "left_tag", "windows", "occurrences"]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``sizes`` from ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(sentences: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sentences cut at entity borders: how many pieces each has, all pieces, and which of them are entities (open, close, name)."""
    if pc.any(pc.match_substring_regex(sentences, "[\u0001\u0002]")).as_py():
        sentences = pc.replace_substring_regex(sentences, "[\u0001\u0002]", "")
    marked = pc.replace_substring_regex(sentences, _ENTITY, "\u0001\\1\u0002\\3\u0002\\2\u0001")
    lists = pc.split_pattern(marked, "\u0001")
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    return sizes, lists.flatten(), _spread(np.zeros(len(sizes), np.int64), sizes) % 2 == 1


def cut_sentences(sentences: pa.Array, tags: tuple[str, str], width: int, reach: int) -> list[pa.Array]:
    """``WINDOW_COLUMNS`` of every entity pair of the sentences.

    The three sorted windows are one text, which is cheaper to group by than lists: tokens with the first control character between them,
    windows with the second one. No token is empty or holds either.
    """
    sentences = sentences.drop_null().cast(pa.string())
    sizes, pieces, entity = _pieces(sentences)
    piece_row = np.repeat(np.arange(len(sentences)), sizes)

    # Entities once each: their tags and names.
    found = pieces.filter(pa.array(entity)).dictionary_encode()
    fields = pc.split_pattern(found.dictionary, "\u0002").flatten()
    opened, closed, names = (fields.take(pa.array(np.arange(i, len(fields), 3))) for i in range(3))
    kind = found.indices.to_numpy()
    is_first, is_second = (pc.equal(opened, t).to_numpy(zero_copy_only=False)[kind] for t in tags)
    paired = pc.equal(closed, tags[0]).to_numpy(zero_copy_only=False)[kind] & is_first

    # Words of the text between them, and every token's place.
    listed = pc.split_pattern(pieces.filter(pa.array(~entity)), " ")
    words = listed.flatten()
    word_piece = np.repeat(np.flatnonzero(~entity), listed.value_lengths().to_numpy())
    kept = pc.binary_length(words).to_numpy() > 0
    words, word_piece = words.filter(pa.array(kept)), word_piece[kept]
    in_piece = np.bincount(word_piece, minlength=len(pieces)) + entity
    first = np.cumsum(in_piece) - in_piece
    total = int(in_piece.sum())
    at_entity = first[entity]
    at_word = np.ones(total, bool)
    at_word[at_entity] = False

    # Tokens as numbers in the order of their bytes.
    coded = pa.concat_arrays([words, names.take(found.indices)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    texts = coded.dictionary.take(order)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    codes = np.empty(total, np.int64)
    numbers = number[coded.indices.to_numpy()]
    codes[at_word], codes[at_entity] = numbers[: len(words)], numbers[len(words) :]
    per_row = np.bincount(piece_row, weights=in_piece, minlength=len(sentences)).astype(np.int64)
    row_end = np.cumsum(per_row)
    row_start = row_end - per_row

    # Site pairs within reach: of each organization the run of locations near it in its sentence.
    entity_row = piece_row[entity]
    orgs, locs, org_row = at_entity[is_first], at_entity[is_second], entity_row[is_first]
    low = np.searchsorted(locs, np.maximum(orgs - reach, row_start[org_row]))
    near = np.maximum(np.searchsorted(locs, np.minimum(orgs + reach, row_end[org_row] - 1), "right") - low, 0)
    a, b, row = np.repeat(orgs, near), locs[_spread(low, near)], np.repeat(org_row, near)

    left, right = np.minimum(a, b), np.maximum(a, b)
    from_left = np.maximum(left - width, row_start[row])
    many = max(len(texts), 1)

    def window(start: np.ndarray, length: np.ndarray) -> pa.Array:
        owner = np.repeat(np.arange(len(start)), length)
        # One sort of numbers sorts every window.
        inside = np.sort(owner * many + codes[_spread(start, length)]) % many
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(inside))), "\u0001")

    org, loc = texts.take(pa.array(codes[a])), texts.take(pa.array(codes[b]))
    # How often the organization is named: its sites, unless markers do not pair off.
    keys, counts = np.unique(org_row * many + codes[orgs], return_counts=True)
    times = counts[np.searchsorted(keys, row * many + codes[a])].astype(np.int64)
    markers = pc.count_substring(sentences, f"<{tags[0]}>").to_numpy()
    sites = np.bincount(entity_row[paired], minlength=len(sentences))
    controls = pc.match_substring_regex(sentences, "[\u0001\u0002]").to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(((markers != sites) | controls | (np.bincount(org_row, minlength=len(sentences)) != sites))[row])
    named = re.compile(f"<{tags[0]}>([^{_LINE_ENDS}]+?)</{tags[0]}>")
    for i in odd:
        times[i] = named.findall(sentences[row[i]].as_py()).count(org[i].as_py())
    windows = [window(from_left, left - from_left), window(left + 1, right - left - 1), window(right + 1, np.minimum(width, row_end[row] - right - 1))]
    left_tag = pa.array(list(tags)).take(pa.array((a > b).astype(np.int64)))
    return [org, loc, left_tag, pc.binary_join_element_wise(*windows, "\u0002"), pa.array(times)]
