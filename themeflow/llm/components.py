"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.operators.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for each node of ``edges``.

    Large-star: every node links its larger neighbours to its smallest one.  Small-star: every node
    links its smaller neighbours to the smallest.  The edge count never grows, and the rounds end
    when nothing changes; they are logarithmic in the longest path.  Each round is written to the
    shared folder, so no round depends on an executor of an earlier one.  Hot nodes are no problem:
    a round needs the minimum per node (a partial aggregate) and a join that adaptive execution
    may split.
    """
    links = stage(
        edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
        .filter(F.col("low") < F.col("high"))
        .distinct(),
        "component-links",
    )
    before = None
    for _ in range(max_rounds):
        links = stage(_small_star(_large_star(links)), "component-links")
        state = links.agg(
            F.count("*").alias("n"),
            F.expr("coalesce(bit_xor(xxhash64(low, high)), 0)").alias("digest"),
        ).first()
        if state == before:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        before = state
    raise RuntimeError("components did not settle")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        links.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("m"))
    joined = links.join(least, "high")
    return (
        joined.select(F.col("m").alias("low"), F.col("low").alias("high"))
        .filter("low < high")
        .unionByName(least.select(F.col("m").alias("low"), "high"))
        .distinct()
    )
