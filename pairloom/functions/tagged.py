"""Expressions over plain and entity-tagged sentences; arguments are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The inline tag syntax.
TAGGED_ENTITY = r"<([A-Z]+)>(.+?)</([A-Z]+)>"

# Two control characters mark entity borders while a sentence is taken apart.
_EDGE = "\u0001"
_INNER = "\u0002"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, computed once per row however often ``body`` uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def exploded(df: DataFrame, kept: list[str], items: Column, *names: str) -> DataFrame:
    """``kept`` columns and one row per item; with two names the first is the position.

    A plain explode of an expression makes the optimizer add a filter that
    computes the expression once more. The outer form does not, and the null it
    yields for an empty list is dropped here.
    """
    generator = F.posexplode_outer(items) if len(names) == 2 else F.explode_outer(items)
    return df.select(*kept, generator.alias(*names)).where(F.col(names[-1]).isNotNull())


def _pieces_sql(sentence: str) -> str:
    """SQL of a sentence cut at entity borders: pieces with an odd number are entities, tag and name with a mark between them."""
    clean = f"if(contains({sentence}, '{_EDGE}') OR contains({sentence}, '{_INNER}'), translate({sentence}, '{_EDGE}{_INNER}', ''), {sentence})"
    return f"split(regexp_replace({clean}, '{TAGGED_ENTITY}', '{_EDGE}$1{_INNER}$2{_EDGE}'), '{_EDGE}')"


def tokens_sql(sentence: str) -> str:
    """SQL of :func:`tagged_tokens`."""
    entity = (
        f"array(named_struct('text', substring_index(c, '{_INNER}', -1), "
        f"'tag', substring_index(c, '{_INNER}', 1)))"
    )
    words = "transform(array_remove(split(c, ' '), ''), w -> named_struct('text', w, 'tag', ''))"
    return f"flatten(transform({_pieces_sql(sentence)}, (c, i) -> if(i % 2 = 1, {entity}, {words})))"


def marked_tokens_sql(sentence: str) -> str:
    """SQL of the same tokens as plain strings, a tagged one with its tag and a mark before it: less work per token than structs."""
    return f"flatten(transform({_pieces_sql(sentence)}, (c, i) -> if(i % 2 = 1, array(c), array_remove(split(c, ' '), ''))))"


def marked_sites_sql(tokens: str, tag: str) -> str:
    """SQL of the 0-based positions of the marked tokens that carry ``tag``."""
    return f"filter(transform({tokens}, (t, i) -> if(startswith(t, '{tag}{_INNER}'), i, null)), i -> i IS NOT NULL)"


def bare_tokens_sql(tokens: str) -> str:
    """SQL of marked tokens without their tags."""
    return f"transform({tokens}, t -> substring_index(t, '{_INNER}', -1))"


def tagged_tokens(sentence: str) -> Column:
    """Tokens of a tagged sentence as ``ARRAY<STRUCT<text, tag>>``.

    An entity is one token whatever its length; other text is cut at single
    spaces, and a word glued to a tag becomes a token of its own. The closing
    tag need not repeat the opening one.
    """
    return F.expr(tokens_sql(sentence))


def entity_names(sentence: str, tag: str) -> Column:
    """Every name between matching ``tag`` markers, repeats kept."""
    return F.regexp_extract_all(sentence, F.lit(f"<{tag}>(.+?)</{tag}>"), 1)


def strip_tags(sentence: str) -> Column:
    """The sentence without its entity tags."""
    return F.regexp_replace(sentence, TAGGED_ENTITY, "$2")


def sites_sql(tokens: str, tag: str) -> str:
    """SQL of the 0-based positions of the tokens that carry ``tag``."""
    return f"filter(transform({tokens}, (t, i) -> if(t.tag = '{tag}', i, null)), i -> i IS NOT NULL)"


def single_spaced(text: Column) -> Column:
    """Whitespace runs as one space, with punctuation set off as tokens."""
    text = F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " ")
    text = F.regexp_replace(text, r'([!?;()"\[\]])', " $1 ")
    text = F.regexp_replace(text, r"([.,:]+)( |\z)", " $1 ")
    return F.trim(F.regexp_replace(text, " +", " "))


# A word of letters in its brackets and marks, and whether a full stop follows: opening, word, full stop, closing.
DOTTED = r"^([(\"\['])*([A-Za-z]+(?:[.'-][A-Za-z]+)*)(\.?)[,;:)\]\"']*$"
_BEFORE_STOP = r"\.([,;:)\]\"']*)$"


def spaced_words(text: str) -> Column:
    """The words of a text between white space."""
    return F.split(F.regexp_replace(F.translate(text, _EDGE + _INNER, ""), "[ \\t\\n\\r\\f]+", " "), " ")


def bare(word: Column) -> Column:
    """The lower-case word without its marks and last full stop; empty if it is no word of letters."""
    return F.lower(F.regexp_extract(word, DOTTED, 2))


def with_full_stop(word: Column) -> Column:
    """Whether a full stop follows a word of letters."""
    return F.regexp_extract(word, DOTTED, 3) == "."


def sentence_list(text: str, abbreviations: str | None = None) -> Column:
    """Sentences of an article: cut after a run of terminators and its closing brackets.

    ``abbreviations`` names a column with those of the article, as :func:`bare` words (NULL: none). Their full stop
    belongs to the word and ends no sentence, except with the text.
    """
    clean = F.translate(text, _EDGE, "")
    if abbreviations:
        held = F.transform(
            spaced_words(text),
            lambda w: F.when(with_full_stop(w) & F.array_contains(abbreviations, bare(w)), F.regexp_replace(w, _BEFORE_STOP, f"{_INNER}$1")).otherwise(w),
        )
        clean = F.when(F.col(abbreviations).isNull(), F.translate(text, _EDGE + _INNER, "")).otherwise(F.array_join(held, " "))
    marked = F.regexp_replace(single_spaced(clean), r"((?: [.!?]+)+(?: [)\]])*) ", f"$1{_EDGE}")
    if abbreviations:
        marked = F.translate(marked, _INNER, ".")
    return F.filter(F.split(marked, _EDGE), lambda s: s != "")
