"""Context vectors: ``ARRAY<STRUCT<token STRING, weight DOUBLE>>`` sorted by token.

Arguments are SQL expressions, most often column names: a higher-order function
over names is one parsed expression instead of dozens of column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.tagged import bind
from pairloom.params import Params

# Rounding errors never decide whether a pair is looked at.
SLACK = 1e-9
VECTOR = "ARRAY<STRUCT<token: STRING, weight: DOUBLE>>"
PARTS = ("lc", "mc", "rc")


def context_vector(window: str) -> Column:
    """Each token's share of a window of tokens; an empty window gives an empty vector."""
    counted = f"transform(d, t -> named_struct('token', t, 'weight', size(filter({window}, x -> x = t)) / size({window})))"
    once = f"transform(d, t -> named_struct('token', t, 'weight', 1 / size({window})))"
    # Most windows repeat no token, so that nothing has to be counted.
    return F.expr(bind(f"sort_array(array_distinct({window}))", "d", f"if(size(d) = size({window}), {once}, {counted})"))


def _total(vector: str) -> str:
    return f"aggregate({vector}, 0D, (acc, x) -> acc + x.weight)"


def vector_total(vector: str) -> Column:
    """Sum of the weights."""
    return F.expr(_total(vector))


def _squared_norm(vector: str) -> str:
    return f"aggregate({vector}, 0D, (acc, x) -> acc + x.weight * x.weight)"


def squared_norm(vector: str) -> Column:
    """Sum of the squared weights."""
    return F.expr(_squared_norm(vector))


def scaled_vector(vector: str) -> Column:
    """The vector with its weights divided by their total; an empty one stays empty."""
    # The total is bound to y once, not computed per token.
    return F.expr(
        f"get(transform(array({_total(vector)}), y -> "
        f"transform({vector}, x -> named_struct('token', x.token, 'weight', x.weight / y))), 0)"
    )


def add_vectors(left: str, right: str) -> Column:
    """Key-wise sum of two vectors."""
    both = f"concat({left}, {right})"
    return F.expr(
        f"transform(sort_array(array_distinct(transform({both}, x -> x.token))), t -> named_struct("
        f"'token', t, 'weight', {_total(f'filter({both}, x -> x.token = t)')}))"
    )


def signature(lc: str = "lc", mc: str = "mc", rc: str = "rc") -> Column:
    """Which contexts are non-empty, as the bits left 4, middle 2, right 1."""
    return F.expr(f"if(size({lc}) > 0, 4, 0) + if(size({mc}) > 0, 2, 0) + if(size({rc}) > 0, 1, 0)")


def lookup(vector: str) -> Column:
    """A vector as a token-to-weight map."""
    return F.expr(f"map_from_entries({vector})")


def _part_score(vector: str, weights: str, norm: str, damped: bool, own: str | None = None) -> str:
    found = f"coalesce(try_element_at({weights}, x.token), 0D)"
    dot = f"aggregate({vector}, 0D, (acc, x) -> acc + x.weight * {found})"
    if damped:
        # The right-hand score counts the weights of shared tokens twice in the centroid's norm.
        damped_norm = f"({norm} + aggregate({vector}, 0D, (acc, x) -> acc + pow({found}, 2)))"
    score = f"try_divide({dot}, sqrt({damped_norm if damped else norm}) * sqrt({own or _squared_norm(vector)}))"
    # The norm tells an empty part: the map may hold the shared tokens only.
    return f"if({f'{own} = 0' if own else f'size({vector}) = 0'} AND {norm} = 0, 0D, {score})"


def degree_of_match(
    left_tag: str,
    vectors: tuple[str, str, str],
    centroid_tag: str,
    centroid_maps: tuple[str, str, str],
    centroid_norms: tuple[str, str, str],
    params: Params = Params(),
    at_least: float = 0.0,
    own_norms: tuple[str, str, str] | None = None,
) -> Column:
    """Similarity of a context with a centroid, in [0, 1].

    The centroid comes as :func:`lookup` maps and :func:`squared_norm` values; of a large centroid the maps may be left with the tokens that
    the context holds, too, since looking a token up takes time linear in a map.
    0 if the two entities come in different order. NULL (never NaN, which would
    pass every threshold) if one side has an empty context where the other has
    none, so such a pair can never match.

    ``own_norms`` are the context's :func:`squared_norm` values where its vectors hold some of their tokens only.

    Similarities below ``at_least`` may come out as NULL: the middle and left
    scores are taken first, and the rest is skipped where even full marks for it
    would not do.
    """
    left, middle, right = (
        _part_score(v, m, n, damped=(i == 2 and not params.plain_cosine), own=o)
        for i, (v, m, n, o) in enumerate(zip(vectors, centroid_maps, centroid_norms, own_norms or (None,) * 3))
    )
    left_most, _, right_most = params.part_ceilings()
    needed = 3 * at_least - SLACK
    total = f"(sl + sm + {right}) / 3"
    with_left = bind(left, "sl", f"if(sl + sm < {needed - right_most}D, null, {total})")
    whole = bind(middle, "sm", f"if(sm < {needed - right_most - left_most}D, null, {with_left})")
    return F.expr(f"if({left_tag} = {centroid_tag}, {whole}, 0D)")


def bucket_of(value: str) -> Column:
    """Histogram bucket: tenths, rounded half up; no value counts as zero."""
    return F.expr(f"CAST(floor(coalesce({value}, 0D) * 10 + 0.5D) AS INT)")
