"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bk_trees, boosted_rules, byte_cnn, filter_audit, filter_cascade, language_id, license_scan, log_bloom, mixture, odd_sketch, oracles, site_templates, structure_repair, suffix_arrays
from .common import read_table, remainder

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_cascade.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mixture.plan_mixture(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return odd_sketch.near_duplicates(docs, width=4)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return site_templates.extract_text(pages).select("page_id", "url", "text", "n_chars", "n_template", "n_marks")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_arrays.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    net = byte_cnn.train_quality(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = byte_cnn.score_quality(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.train_language_model(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    model, table = log_bloom.train(docs.where(~held_out))
    scored = log_bloom.score(docs, model, table)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: thousand / hundred / ten / id. The first document of a ten stands for
    the licence file of its directory, the first of a hundred for its parent's, of a thousand for the top's."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folders = [F.expr(f"doc_id div {n}") for n in (1000, 100, 10)]
    place = F.concat_ws("/", *folders, F.concat("doc_id", F.lit(".txt")))
    for depth, n in ((3, 10), (2, 100), (1, 1000)):
        place = F.when(F.col("doc_id") % n == 0, F.concat_ws("/", *folders[:depth], F.lit("LICENSE"))).otherwise(place)
    files = docs.select("doc_id", "text", place.alias("path"))
    return license_scan.scan_licenses(files).select("doc_id", "path", "license", "how", "cosine", "licensed_by")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = boosted_rules.train_rules(docs, read_table(spark, sf_dir, "labels"))
    judged = boosted_rules.apply_rules(docs, trees)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = structure_repair.repair_conversations(structure_repair.damage_conversations(rows), known=rows)
    digests = found.digests().select(F.col("conv_id").alias("id"), F.col("sha256").alias("repaired_sha256"))
    return found.report.join(digests, F.expr("conv_id <=> id")).drop("id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit_filters(docs, read_table(spark, sf_dir, "labels"))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bk_trees.near_duplicates(docs, width=3)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixture, op3_near_duplicates, op4_html_extraction, op5_decontamination, op6_quality_classifier, op7_language_id, op8_lm_scoring, op9_license_scan, op10_quality_rules, op11_conversation_repair, op12_filter_audit, op13_simhash_duplicates)}
ORACLES: dict[str, str] = {
    "op1_url_filter": oracles.URL_FILTER,
    "op3_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op12_filter_audit": oracles.FILTER_AUDIT,
}
