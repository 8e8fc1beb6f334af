"""Preference formatting, in DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; what follows in either is
its completion. Results are segments, a row for each rendered turn, in order of (pair, part, place): a conversation of any length is
never gathered in one row. A mask says which characters of a segment are learned: the text of assistant turns of completions, with the
end mark; nothing of the prompt.

Defined results: null roles and texts equal one another and are rendered empty; turns follow one another by turn (null first), role and
text, and rows that are equal in all stay as they are; a conversation without a partner has an empty prefix; rows with a
null conv_id belong to no conversation and are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"
LEARNED = "assistant"


def turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, side, place, role, text: conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    conv = F.col(conv_col).cast("long")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(conv.alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where(F.col("conv").isNotNull())
    side = F.when(F.pmod("conv", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return rows.select(F.floor(F.col("conv") / 2).cast("long").alias("pair_id"), side.alias("side"), (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "text")


def prefixes(pair_turns: DataFrame) -> DataFrame:
    """pair_id, n_prefix: turns that both conversations begin with."""
    one, other = (pair_turns.where(F.col("side") == s).select("pair_id", "place", F.struct("role", "text").alias(s)) for s in ("chosen", "rejected"))
    met = one.join(other, ["pair_id", "place"], "full")
    same = F.col("chosen").isNotNull() & F.col("chosen").eqNullSafe(F.col("rejected"))
    return met.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~same, F.col("place"))), F.count("*")).cast("long").alias("n_prefix"))


def segments(pair_turns: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), place, content, mask_start, mask_end (characters that are learned), n_prefix."""
    rows = pair_turns.join(prefixes(pair_turns), "pair_id")
    in_prefix = F.col("place") < F.col("n_prefix")
    rows = rows.where(~in_prefix | (F.col("side") == "chosen"))
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"))
    content = F.concat(header, F.coalesce("text", F.lit("")), F.lit(END))
    learned = ~in_prefix & F.col("role").eqNullSafe(F.lit(LEARNED))
    part = F.when(in_prefix, "prompt").otherwise(F.col("side"))
    start = F.when(learned, F.length(header)).otherwise(0).cast("long")
    end = F.when(learned, F.length(content)).otherwise(0).cast("long")
    return rows.select("pair_id", part.alias("part"), "place", content.alias("content"), start.alias("mask_start"), end.alias("mask_end"), "n_prefix")
