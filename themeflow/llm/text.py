"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.operators.staging import stage

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once per row, however often it is used.

    A column used inside a lambda is otherwise copied into it and evaluated for each element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda part: part != "")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` reduced to ``__id``, ``__hash`` (of the text) and ``__text``.

    Rows with the same id and the same text have the same results, so (id, hash) finds a row's
    results again, even where ids repeat or are null.
    """
    return docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__hash"),
        F.col(text_col).alias("__text"),
    )


#: Results are broadcast to their rows up to this many bytes; above, rows and results meet in a shuffle.
RESULT_BYTES = 32 << 20


def with_results(
    docs: DataFrame, results: DataFrame, id_col: str, text_col: str, size: Column | None = None,
    broadcast_bytes: int = RESULT_BYTES,
) -> DataFrame:
    """Left join of ``results`` (unique ``__id``, ``__hash``) to the rows they belong to.

    With ``size``, the bytes of a row of ``results``, they are staged and measured: few of them are
    broadcast, so that no text moves.
    """
    if size is not None:
        results = stage(results, "row-results")
        if results.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= broadcast_bytes:
            results = F.broadcast(results)
    keyed = docs.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    renamed = results.withColumnsRenamed({"__id": "__result_id", "__hash": "__result_hash"})
    return keyed.join(
        renamed,
        F.col(id_col).eqNullSafe(F.col("__result_id"))
        & (F.col("__text_hash") == F.col("__result_hash")),
        "left",
    ).drop("__text_hash", "__result_id", "__result_hash")


class Shield:
    """Moves columns of a table that are called as an operator's own (``__...``) out of its way."""

    def __init__(self, docs: DataFrame) -> None:
        names = {c.lower() for c in docs.columns}
        prefix = "col"
        while any(n.startswith(prefix) for n in names):
            prefix += "x"
        self._moved = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        self.docs = docs.withColumnsRenamed(self._moved)

    def name(self, column: str) -> str:
        return self._moved.get(column, column)

    def back(self, found: DataFrame) -> DataFrame:
        return found.withColumnsRenamed({v: k for k, v in self._moved.items()})
