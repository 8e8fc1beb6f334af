"""Joins whose keys may hold a large share of all rows.

Frequent keys are found by a sketch of frequent items, which is merged from partial sketches of fixed size. Rows of such a key are dealt to
as many pieces as its share of the rows asks for, and the few rows of the other side are repeated for each piece. All other keys are
joined as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch follows (its counts are off by less than the rows over three quarters of this), and the most that are reported.
TRACKED, MOST_KEYS = 10_000, 1_000


def hot_keys(rows: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """One row, for each key column a list ``(item, pieces)`` of the values with more rows than an even share of a partition.

    A value gets as many pieces as it has even shares, so none is larger than a
    share. Nulls join nothing and are not counted. At most ``MOST_KEYS`` values
    of a column are listed: the table has a fixed bound. Without rows the lists
    are empty.
    """
    shares = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(max(shares, 1), MOST_KEYS)
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"approx_top_k(`{c}`, {k}, {TRACKED})").alias(c) for c in keys))
    pieces = "CAST(ceil(x.count * {0} / n) AS INT)".format(shares)
    listed = "transform(filter(coalesce(`{0}`, array()), x -> x.item IS NOT NULL AND x.count * {1} > n), x -> named_struct('item', x.item, 'pieces', {2}))"
    return found.select(*(F.expr(listed.format(c, shares, pieces)).alias(c) for c in keys))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame | None, key: str) -> DataFrame:
    """The inner join of ``many`` and ``few`` by the columns ``on``; rows of ``many`` whose ``key``, one of them, is hot are dealt out.

    ``hot`` has a column ``key`` as :func:`hot_keys` gives it (``None``: a plain
    join). The piece of a row is a hash of the row, so a task that is run again
    deals alike.
    """
    if hot is None:
        return many.join(few, on)
    listed = F.broadcast(hot.select(F.explode(key).alias("h")).select(F.col("h.item").alias("hot_item"), F.col("h.pieces").alias("hot_pieces")))
    row = [F.col(f"`{c}`") for c in many.columns]
    dealt = many.join(listed, F.col(key) == F.col("hot_item"), "left")
    dealt = dealt.withColumn("hot_piece", F.coalesce(F.pmod(F.xxhash64(*row), F.col("hot_pieces").cast("bigint")), F.lit(0).cast("bigint"))).drop("hot_item", "hot_pieces")
    repeated = few.join(listed, F.col(key) == F.col("hot_item"), "left")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("hot_pieces"), F.lit(1)) - F.lit(1).cast("bigint"))
    repeated = repeated.withColumn("hot_piece", F.explode(pieces)).drop("hot_item", "hot_pieces")
    return dealt.join(repeated, [*on, "hot_piece"]).drop("hot_piece")
