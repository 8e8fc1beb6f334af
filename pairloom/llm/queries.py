"""The registered queries of the operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, html, lines, merkle, mixing, neardup, preference, quality, spelling, substring, tokens, topk, toxicity
from pairloom.llm.common import LOWER, UPPER, fold, shared_folder

#: Scores from which a document counts as good, and a text as toxic.
GOOD = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mixture(table(spark, sf_dir, "documents"))
    plan = F.col("plan")
    return rows.select(F.col("key").alias("doc_id"), "size", plan["source_size"].alias("source_size"), plan["target"].alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.segments(preference.turns(table(spark, sf_dir, "conversations")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = lines.without_site_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return rows.select("doc_id", "text", F.col(dropped).alias("n_dropped"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = decontaminate.matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = F.col(name)
    n_items, digest = decontaminate.item_digest(found["matches"])
    return rows.select("doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"), n_items.alias("n_items"), digest.alias("items_sha256"), (found["n_hit"] > 0).alias("contaminated"))


def encoded(docs: DataFrame) -> DataFrame:
    """Documents written as sequence files and read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokens.write_sequences(docs, shared_folder(docs.sparkSession), tokenizer=path, vocabulary=50_257, end_id=2)
    return tokens.read_documents(files).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("key"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.QualityModel:
    return quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("key"), 4) != 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality_model(spark, sf_dir, docs))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.digest(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields))
    shown = F.when(fold(F.col("doc_id"), 5) == 0, tampered)
    proved = merkle.manifest(docs, fields, group_col="source", id_col="doc_id", shown=shown)
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_preference": op2_preference,
    "op3_neardup": op3_neardup,
    "op4_lines": op4_lines,
    "op5_decontamination": op5_decontamination,
    "op6_tokens": op6_tokens,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_substring": op11_substring,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}
