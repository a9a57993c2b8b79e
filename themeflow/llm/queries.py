"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm import decontaminate, language, line_dedup, manifest, maxent_lm, packing, pii, quality_qda
from themeflow.llm import quality_rules, repeats, secret_scan, simhash, spelling
from themeflow.llm.text import table


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random"
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality_qda.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return found


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("__id").alias("doc_id"),
        simhash.hex_print(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = packing.pack(table(spark, sf_dir, "documents"))
    return found


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), removed_col="removed")
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        "text",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality_rules.judged(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_spellings(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = language.predict(table(spark, sf_dir, "documents"))
    return found


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.verified(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_maxent_lm": op5_maxent_lm,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_repeats": op10_repeats,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
}
