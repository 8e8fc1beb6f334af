"""Line removal by site-relative frequency, in DataFrame functions only.

For every host, the share of its pages that hold a line is taken over all pages; lines above the boilerplate ratio are dropped. A line
counts once per page. Lines travel as two 64-bit hashes, summed up before the shuffle, and a host keeps at most (lines of a page /
ratio) of them, so texts are never shuffled.

Defined results: a null host is a host of its own; a null text stays null, an empty one empty; blank lines are never dropped; on a host
with fewer than `least_pages` pages nothing is dropped; repeated rows are pages each; a text of dropped lines only becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, staged, unused

#: Lists of lines are a row for each host; beyond this many hosts the join is left to a shuffle.
BROADCAST_HOSTS = 20_000


def _code(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _page_lines(pages: DataFrame, host: Column, text_col: str) -> DataFrame:
    """host, code: each different line of a page that isn't blank, once; and a row with a null code for the page."""
    codes = F.array_distinct(F.transform(F.filter(_lines(column(text_col)), lambda x: F.trim(x) != ""), _code))
    nothing = F.array(F.lit(None).cast("struct<a:long,b:long>"))
    return pages.select(host.alias("host"), F.explode(F.concat(nothing, F.coalesce(codes, F.array().cast("array<struct<a:long,b:long>>")))).alias("code"))


def site_lines(pages: DataFrame, host: Column, *, text_col: str = "text", ratio: float = 0.1, least_pages: int = 10) -> DataFrame:
    """host, lines: the codes of each host's boilerplate lines."""
    counts = staged(_page_lines(pages, host, text_col).groupBy("host", "code").agg(F.count("*").alias("n")))
    totals = counts.where(F.col("code").isNull() & (F.col("n") >= least_pages)).select(F.col("host").alias("of"), F.col("n").alias("total"))
    # a line above the ratio of a host of at least least_pages pages has at least this count: most lines go before the join
    common = counts.where(F.col("code").isNotNull() & (F.col("n") > ratio * least_pages))
    return common.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("code").alias("lines"))


def without_site_lines(pages: DataFrame, host: Column, *, text_col: str = "text", ratio: float = 0.1, least_pages: int = 10) -> tuple[DataFrame, str]:
    """All rows and columns of pages, the text without its host's boilerplate lines; also the name of the column with the number dropped."""
    dropped, found, of = unused(pages, "n_dropped"), unused(pages, "site_lines"), unused(pages, "site_host")
    listed = staged(site_lines(pages, host, text_col=text_col, ratio=ratio, least_pages=least_pages))
    side = listed.select(F.col("host").alias(of), F.col("lines").alias(found))
    side = F.broadcast(side) if listed.count() <= BROADCAST_HOSTS else side
    rows = pages.join(side, host.eqNullSafe(F.col(of)), "left")
    kept = F.when(F.col(found).isNull(), _lines(column(text_col))).otherwise(F.filter(_lines(column(text_col)), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(found), _code(x))))
    rows = rows.withColumn(dropped, F.coalesce(F.size(_lines(column(text_col))) - F.size(kept), F.lit(0)).cast("long"))
    return rows.withColumn(text_col, F.when(column(dropped) > 0, F.array_join(kept, "\n")).otherwise(column(text_col))).drop(found, of), dropped
