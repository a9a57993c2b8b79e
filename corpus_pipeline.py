"""From raw documents to padded training batches, five stages.

Quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.  Each stage is
written as Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from themeflow.llm.text import table
from themeflow.operators.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay in one document; every document stays."""
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose 3-word fingerprints link at 2 or fewer bits."""
    return simhash.drop_near_copies(docs, shingle=3, distance=2, blocks=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of test items are cut out."""
    found = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), "spans")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in padded batches."""
    found, _ = packing.pack(docs)
    return found


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", copies),
    ("decontamination", benchmark),
    ("packing", batches),
]

#: Learned rules, fingerprints and boundaries aren't SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
