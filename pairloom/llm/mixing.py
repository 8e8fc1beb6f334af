"""Mixing sources to target weights: words per source, repetition rates, and seeded copies of documents.

Each source gets a share of the target total by weight, at most `most` times its own size; what is above goes to the others by weight
until no source is above (water filling). A document is taken floor(rate) times, and once more if a hash of its key falls below the
fraction, so reruns agree and no document knows of another.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; a source without words has target 0
and its documents are taken once per whole rate (never); equal rows are taken alike; a null key has the hash of the empty key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import WORD, column, staged, unused

#: Sources are one row each after aggregation; beyond this many the join is left to a shuffle.
BROADCAST_SOURCES = 20_000
_HASHES = 1 << 32
#: Ways to turn the hashes of a source, of which it keeps one.
TURNS = 16


def text_size(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights dealt to the sources in turn, by code point, null last. One row per source meets here."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, weight -> also target, with sum of targets = sum of sizes.

    A source is full where most * size <= level * weight. Sorted by size / weight, the full ones come first, so the level is what
    the rest has to share at the first source that is not full. One row per source meets here.
    """
    full = F.lit(most) * F.col("source_size")
    by_need = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = sizes.withColumn("level", left.cast("double") / heavy).withColumn("open", F.col("level") * F.col("weight") <= full)
    level = F.min(F.when(F.col("open"), F.struct((full / F.col("weight")).alias("need"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(full.cast("double"), F.coalesce(level * F.col("weight"), full.cast("double")))
    return leveled.withColumn("target", target).drop("level", "open")


def copies_of(key: Column, rate: Column, turn: Column, seed: str) -> Column:
    """floor(rate), plus one with the probability of the fraction, by a hash of seed and key, turned by turn / TURNS."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    chance = ((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + turn.cast("long") * (_HASHES // TURNS)) % _HASHES).cast("double") / _HASHES
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(sizes: DataFrame, weights=cycling_weights, most: int = 3, seed: str = "mix-1:") -> DataFrame:
    """key, source, size -> a row per source: source, source_size, target, rate, turn.

    A few long documents can take a source off its target by chance. So the hashes are turned by each of TURNS sixteenths, and a source
    keeps the turn whose taken words come nearest to its target: still one hash and one probability per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(weights(totals), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = staged(targets.select("source", "source_size", "target", rate.alias("rate")))
    rows = _with_plan(sizes, F.col("source"), targets, "plan")
    taken = [F.sum(F.col("size") * copies_of(F.col("key"), F.col("plan")["rate"], F.lit(k), seed)).alias(f"taken_{k}") for k in range(TURNS)]
    tried = rows.groupBy(F.col("source").alias("of")).agg(*taken)
    off = [F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(TURNS)]
    return staged(targets.join(tried, F.col("source").eqNullSafe(F.col("of")), "left").select(*targets.columns, F.coalesce(F.least(*off)["turn"], F.lit(0)).alias("turn")))


def _with_plan(rows: DataFrame, source: Column, plan: DataFrame, name: str) -> DataFrame:
    packed = plan.select(F.struct(*plan.columns).alias(name))
    side = F.broadcast(packed) if plan.count() <= BROADCAST_SOURCES else packed
    return rows.join(side, source.eqNullSafe(F.col(name)["source"]), "left")


def mixture(docs: DataFrame, weights=cycling_weights, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: str = "mix-1:") -> tuple[DataFrame, DataFrame]:
    """key, source, size, and a struct `plan` and `copies` for every document; and the plan, a row per source.

    weights: turns (source, source_size) into (source, source_size, weight).
    """
    sizes = staged(docs.select(column(id_col).alias("key"), column(source_col).alias("source"), text_size(column(text_col)).alias("size")))
    plan = mix_plan(sizes, weights, most, seed)
    return _with_plan(sizes, F.col("source"), plan, "plan").withColumn("copies", copies_of(F.col("key"), F.col("plan")["rate"], F.col("plan")["turn"], seed)), plan


def mixed_documents(docs: DataFrame, weights=cycling_weights, *, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix-1:", **options) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it."""
    _, plan = mixture(docs, weights, id_col=id_col, source_col=source_col, seed=seed, **options)
    name = unused(docs, "plan")
    turn = unused(docs, "turn")
    rows = _with_plan(docs, column(source_col), plan, name)
    copies = copies_of(column(id_col), F.col(name)["rate"], F.col(name)["turn"], seed)
    return rows.where(copies > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*[column(c) for c in docs.columns])
