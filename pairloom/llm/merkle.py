"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; the leaves of a group (a source) stand in the order of their keys. While several nodes of a group remain, every
WIDTH consecutive ones become their digest; the last node is the group's subroot, and the subroots of all groups, in order, become the
root in the same way.

Leaves are sorted by (group, key) over all tasks and numbered from counts of each sorted slice, so a large group is no large task.
WIDTH ** HEIGHT consecutive leaves of a group form a superblock. A first pass reduces each to one digest; the few nodes above are
reduced level by level. Then the leaves of each superblock are cogrouped with the runs of outer nodes on its way to the root, and one
applyInPandas finishes the block's own levels, joins the proof of each leaf and folds it. A group holds WIDTH ** HEIGHT leaves and one
run of WIDTH digests for each level above, whatever the size of the table.

Defined results: null values are hashed as `-`; a null key sorts first, a null group too; rows of one key are ordered by their digest,
so repeated rows have a place each; a row alone in its group is the subroot, an empty table has no rows. Texts are hashed whole.
Columns that are not hashed are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import column, staged

#: Children of a node, and levels inside a superblock.
WIDTH, HEIGHT = 16, 2
BLOCK = WIDTH**HEIGHT
#: Levels of the tree over the groups are numbered from here.
TOP = 64

PROVED = "key long, leaf string, subroot string, root string, siblings array<string>, places array<int>, widths array<int>, folded_root string"


def encoded(value: Column) -> Column:
    """`-` for a null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the encoded values."""
    return F.sha2(F.concat(*(encoded(v) for v in values)).cast("binary"), 256)


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels(leaves: list[str], total: int, height: int = HEIGHT) -> list[list[str]]:
    """The levels of a superblock from its leaves up; `total` is the number of leaves of its group, which ends early if it is one block."""
    found = [leaves]
    while len(found) <= height and total > 1:
        below = found[-1]
        found.append([node(below[i : i + WIDTH]) for i in range(0, len(below), WIDTH)])
        total = -(-total // WIDTH)
    return found


def fold(leaf: str, siblings: Sequence[str], places: Sequence[int], widths: Sequence[int]) -> str:
    """The root that a leaf and its siblings (level by level, left to right) lead to."""
    at = 0
    for place, width in zip(places, widths, strict=True):
        run = list(siblings[at : at + width - 1])
        at += width - 1
        leaf = node([*run[:place], leaf, *run[place:]])
    return leaf


def numbered_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (group, key, leaf, shown) numbered: (owner, total, rank, ...) and the groups (owner, total)."""
    within = F.monotonically_increasing_id()
    placed = leaves.orderBy("group", "key", "leaf").select("*", F.shiftright(within, 33).alias("slice"), within.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    placed = staged(placed)
    counts = placed.groupBy("slice", "group").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    of_group = Window.partitionBy("group").orderBy("slice")
    before = F.coalesce(F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("group"))
    counts = staged(counts.select("slice", "group", "n", "first", before.alias("before"), total.alias("total")))
    # A group is numbered by the slice in which it starts and its place there. There are as many slices as sort partitions.
    starts = counts.where("before = 0")
    slices = starts.groupBy("slice").agg(F.count(F.lit(1)).alias("groups"))
    earlier = F.coalesce(F.sum("groups").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select("slice", earlier.alias("earlier"))
    here = F.row_number().over(Window.partitionBy("slice").orderBy("first")) - 1
    owners = starts.withColumn("here", here).join(slices, "slice").select("group", (F.col("earlier") + F.col("here")).cast("long").alias("owner"), "total")
    owners = staged(owners)
    offsets = counts.alias("c").join(owners.alias("o"), F.col("c.group").eqNullSafe(F.col("o.group"))).select("slice", F.col("c.group").alias("of"), (F.col("before") - F.col("first")).alias("shift"), "owner", "o.total")
    same = (placed["slice"] == offsets["slice"]) & placed["group"].eqNullSafe(offsets["of"])
    rows = placed.join(offsets, same).select("owner", "total", (F.col("place") + F.col("shift")).alias("rank"), "key", "leaf", "shown")
    return rows.withColumn("block", F.floor(F.col("rank") / BLOCK)), owners.select("owner", "total")


def _block_digest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rank")
    total = int(rows["total"].iloc[0])
    return pd.DataFrame({"owner": [key[0]], "idx": [key[1]], "digest": [levels(rows["leaf"].tolist(), total)[-1][0]], "nodes": [-(-total // BLOCK)]})


def reduced(nodes: DataFrame, first_level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Runs (level, owner, run, children) and the last node (owner, idx, digest) of trees over (owner, idx, digest, nodes).

    `most` is the greatest number of nodes of an owner, which says how many levels there are.
    """
    runs = nodes.select(F.lit(0).alias("level"), "owner", F.col("idx").alias("run"), F.array("digest").alias("children")).where("false")
    level = first_level
    while most > 1:
        open_ = nodes.where("nodes > 1")
        run = open_.groupBy("owner", F.floor(F.col("idx") / WIDTH).alias("run"), "nodes").agg(F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"].alias("children"))
        run = staged(run)
        runs = runs.unionByName(run.select(F.lit(level).alias("level"), "owner", "run", "children"))
        up = run.select("owner", F.col("run").alias("idx"), F.sha2(F.array_join("children", "").cast("binary"), 256).alias("digest"), F.ceil(F.col("nodes") / WIDTH).alias("nodes"))
        nodes = nodes.where("nodes = 1").unionByName(up)
        most = -(-most // WIDTH)
        level += 1
    return runs, nodes


def _way(idx: Column, nodes: Column, owner: Column, level: int) -> Column:
    """The runs that a node is part of, up to the last node of its tree: an array of (level, owner, run, place)."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda h: nodes > F.pow(F.lit(WIDTH), h))
    at = lambda h: F.floor(idx / F.pow(F.lit(WIDTH), h)).cast("long")
    return F.transform(steps, lambda h: F.struct((h + level).alias("level"), owner.alias("of"), F.floor(at(h) / WIDTH).alias("run"), (at(h) % WIDTH).cast("int").alias("place")))


def _prove(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows, outer = rows.sort_values("rank"), outer.sort_values("level")
    own = levels(rows["leaf"].tolist(), int(rows["total"].iloc[0]))
    # Above the block every leaf has the same siblings.
    above = [(int(level), int(place), list(children)) for level, place, children in zip(outer["level"], outer["place"], outer["children"], strict=True)]
    tail = [c for _, place, children in above for i, c in enumerate(children) if i != place]
    subroot = root = own[-1][0]
    for level, _, children in above:
        root = node(children)
        subroot = root if level < TOP else subroot
    out: list[tuple] = []
    for i, (key_, leaf, shown) in enumerate(zip(rows["key"], rows["leaf"], rows["shown"], strict=True)):
        siblings, places, widths = [], [], []
        for level in own[:-1]:
            start = i - i % WIDTH
            run = level[start : start + WIDTH]
            siblings += run[: i - start] + run[i - start + 1 :]
            places.append(i - start)
            widths.append(len(run))
            i //= WIDTH
        siblings += tail
        places += [place for _, place, _ in above]
        widths += [len(children) for _, _, children in above]
        out.append((key_, leaf, subroot, root, siblings, places, widths, fold(shown or leaf, siblings, places, widths)))
    return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "siblings", "places", "widths", "folded_root"]).astype({"key": "Int64"})


def manifest(docs: DataFrame, fields: Sequence[str], *, group_col: str, id_col: str, shown: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, siblings, places, widths, folded_root: every row of docs with its proof.

    The leaf is the digest of `fields`. `siblings` are the other nodes of the runs on the way to the root; `places` and `widths` say
    where in its run a node stands and how long the run is, level by level. `folded_root` follows from the siblings and the leaf
    `shown` (a column of docs, null for the leaf itself), so it differs from `root` where something else is shown.
    """
    leaf = digest(*(column(c) for c in fields))
    shown = F.lit(None).cast("string") if shown is None else shown
    rows, owners = numbered_leaves(docs.select(column(group_col).cast("string").alias("group"), column(id_col).cast("long").alias("key"), leaf.alias("leaf"), shown.alias("shown")))
    rows = staged(rows)
    most, groups = owners.agg(F.coalesce(F.max("total"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = rows.select("owner", "block", "rank", "total", "leaf").groupBy("owner", "block").applyInPandas(_block_digest, "owner long, idx long, digest string, nodes long")
    blocks = staged(blocks)
    runs, subroots = reduced(blocks, HEIGHT, -(-most // BLOCK))
    top, _ = reduced(subroots.select(F.lit(-1).cast("long").alias("owner"), F.col("owner").alias("idx"), "digest", F.lit(groups).cast("long").alias("nodes")), TOP, groups)
    way = F.concat(_way(F.col("idx"), F.col("nodes"), F.col("owner"), HEIGHT), _way(F.col("owner"), F.lit(groups), F.lit(-1).cast("long"), TOP))
    steps = blocks.select("owner", F.col("idx").alias("block"), F.explode(way).alias("s")).select(F.col("owner").alias("own"), "block", "s.*")
    known = runs.unionByName(top)
    met = (steps["level"] == known["level"]) & (steps["of"] == known["owner"]) & (steps["run"] == known["run"])
    outer = steps.join(known, met).select(F.col("own").alias("owner"), "block", steps["level"], "place", "children")
    return rows.groupBy("owner", "block").cogroup(outer.groupBy("owner", "block")).applyInPandas(_prove, PROVED)
