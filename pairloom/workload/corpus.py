"""Text inputs rendered from the given tables.

The tables hold no tagged sentences, so one is rendered per lineitem row: a
supplier near its own nation (the true relation) or near a customer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.tagged import strip_tags

# Fixed values, readable by Spark and by DuckDB alike. {o} organization, {n} its
# nation, {c} the customer's nation, {p} part, {k} order key.
TEMPLATES = [
    "Analysts said <ORGANIZATION>{o}</ORGANIZATION> , based in <LOCATION>{n}</LOCATION> , sold more {p} units .",
    "Shares of <ORGANIZATION>{o}</ORGANIZATION> , headquartered in <LOCATION>{n}</LOCATION> , rose after {p} sales .",
    "The <LOCATION>{n}</LOCATION> - based <ORGANIZATION>{o}</ORGANIZATION> announced a {p} plant .",
    "Yesterday <ORGANIZATION>{o}</ORGANIZATION> shipped {p} goods to <LOCATION>{c}</LOCATION> by rail .",
    "<ORGANIZATION>{o}</ORGANIZATION> of <LOCATION>{n}</LOCATION> declined to comment .",
    "In <LOCATION>{c}</LOCATION> , officials met <ORGANIZATION>{o}</ORGANIZATION> about {p} imports .",
    "The <ORGANIZATION>{o}</ORGANIZATION> board will meet again next week in <LOCATION>{n}</LOCATION> .",
    "Chairman <PERSON>Customer {k}</PERSON> of <ORGANIZATION>{o}</ORGANIZATION> resigned .",
    "Rivals <ORGANIZATION>{o}</ORGANIZATION> and <ORGANIZATION>{o}</ORGANIZATION> in <LOCATION>{c}</LOCATION> merged .",
    "Sales of {p} rose in <LOCATION>{c}</LOCATION> .",
]
# Reports with abbreviations, each sentence's last word also elsewhere within one.
REPORTS = [
    "Mr. Smith of {o} Inc. met officials in the U.S. on Monday. Sales of {p} came back and rose.",
    "On Monday sales rose in {n}, Dr. Brown said. Dr. Brown of {o} Inc. said that {p} prices rose on Monday, too.",
    "Prices, too, were said to fall. {o} Co. shipped {p} to {n} and the U.S. where it could. Officials rose to meet Mr. Smith, who had to fall back.",
]
# Sentences with a tag for each word, some of which depend on their neighbours. {q} is a part, tagged.
TAGGED = [
    "Analysts_NNS said_VBD {o}_NNP will_MD plant_VB more_JJR trees_NNS in_IN {n}_NNP ._.",
    "The_DT plant_NN of_IN {o}_NNP sold_VBD more_JJR {q} units_NNS ._.",
    "Shares_NNS rose_VBD after_IN the_DT board_NN met_VBD in_IN {n}_NNP ._.",
    "They_PRP board_VB the_DT rail_NN cars_NNS to_TO {n}_NNP ,_, officials_NNS said_VBD ._.",
    "A_DT rose_NN by_IN the_DT rail_NN was_VBD sold_VBN ,_, and_CC rivals_NNS will_MD comment_VB ._.",
    "Yesterday_NN {o}_NNP declined_VBD to_TO comment_VB about_IN {q} imports_NNS ._.",
    "{o}_NNP imports_VBZ {q} goods_NNS and_CC based_VBD its_PRP$ forecast_NN on_IN sales_NNS ._.",
    "Units_NNS based_VBN in_IN {n}_NNP will_MD meet_VB again_RB next_JJ week_NN ._.",
]
FIELDS = {"{q}": "concat(replace(p_name, ' ', '_JJ '), '_NN')", "{o}": "s_name", "{n}": "sn.n_name", "{c}": "cn.n_name", "{p}": "p_name", "{k}": "CAST(l_orderkey AS STRING)"}


def sentence_expression(templates: list[str] = TEMPLATES) -> str:
    """The rendering as one SQL expression."""

    def filled(template: str) -> str:
        text = "'" + template + "'"
        for field, column in FIELDS.items():
            text = text.replace(field, f"', {column}, '")
        return f"concat({text})"

    cases = " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(templates))
    return f"CASE (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % {len(templates)} {cases} END"


SENTENCE_ID = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are expensive to work on, over at least as many tasks as there are cores.

    A large table already comes in more splits than that and is left as it is.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sentence_id, sentence)``, one per lineitem row. The largest tables are joined first, when a row is its keys, and names last."""
    nation = table(spark, sf_dir, "nation")
    customers = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    return (
        wide_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        .join(customers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.alias("sn"), F.col("s_nationkey") == F.col("sn.n_nationkey"))
        .join(nation.alias("cn"), F.col("c_nationkey") == F.col("cn.n_nationkey"))
        .select(F.expr(SENTENCE_ID).alias("sentence_id"), F.expr(sentence_expression()).alias("sentence"))
    )


def plain_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sentences without tags."""
    return tagged_sentences(spark, sf_dir).withColumn("sentence", strip_tags("sentence"))


def word_tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text)``: a sentence of ``word_TAG`` items per lineitem row."""
    return (
        wide_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation").alias("sn"), F.col("s_nationkey") == F.col("sn.n_nationkey"))
        .select(F.expr(sentence_expression(TAGGED)).alias("text"))
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line)``: one article with abbreviations per lineitem row, numbered by its order."""
    text = F.expr(sentence_expression(REPORTS))
    return (
        wide_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation").alias("sn"), F.col("s_nationkey") == F.col("sn.n_nationkey"))
        .select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("en"), F.lit("reports"), F.lit(""), text).alias("line"))
    )


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(org, loc, region, s_acctbal)``: the true relation."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_name").alias("org"), F.col("n_name").alias("loc"), F.col("r_name").alias("region"), "s_acctbal")
    )


def seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(org, loc)``: what everyone knows, the richest supplier of each region."""
    richest = F.max(F.struct("s_acctbal", "org", "loc")).alias("s")
    return supplier_nations(spark, sf_dir).groupBy("region").agg(richest).select("s.org", "s.loc")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, tag)``: suppliers and nations."""
    organizations = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("tag"))
    locations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("LOCATION").alias("tag"))
    return organizations.union(locations)


def product_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, tag)``: suppliers, nations and parts, whose names have two tokens."""
    return gazetteer(spark, sf_dir).union(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("PRODUCT").alias("tag")))


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line)``: the true relation as tab-separated lines with an extra field."""
    columns = ["org", "loc", F.col("s_acctbal").cast("bigint").cast("string")]
    return supplier_nations(spark, sf_dir).select(F.concat_ws("\t", *columns).alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line)``: documents as tab-separated articles, newlines as the two characters ``\\n``."""
    text = F.replace("text", F.lit("\n"), F.lit("\\n"))
    fields = [F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"), text]
    return wide_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars", "text").select(F.concat_ws("\t", *fields).alias("line"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line)``: conversation turns in the same form."""
    text = F.replace("text", F.lit("\n"), F.lit("\\n"))
    turn = F.col("turn").cast("string")
    fields = [F.col("conv_id").cast("string"), turn, "role", turn, text]
    return table(spark, sf_dir, "conversations").select(F.concat_ws("\t", *fields).alias("line"))


def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line)``: each untagged sentence as a one-sentence article numbered by its order."""
    sentences = plain_sentences(spark, sf_dir)
    order = F.substring_index("sentence_id", "-", 1)
    return sentences.select(
        F.concat_ws("\t", order, F.lit("en"), F.lit("news"), F.length("sentence").cast("string"), "sentence").alias("line")
    )


# The tag of a word by its shape, readable by Spark and by DuckDB alike.
SHAPE_TAG = (
    "CASE WHEN {like}(w, '^[0-9]+$') THEN 'CD' "
    "WHEN {like}(w, '^[A-Z][a-z]+$') THEN 'NNP' "
    "WHEN {like}(w, '^[A-Z]+$') THEN 'NP' "
    "WHEN {like}(w, '^[.,;:!?()]+$') THEN 'PUNCT' "
    "WHEN {like}(w, '^[a-z]+$') THEN 'NN' ELSE 'X' END"
)
