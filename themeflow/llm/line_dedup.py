"""Line dedup by distinct-site spread: one HyperLogLog sketch of sites per line.

DataFrame functions only.  Lines travel as hashes.  A sketch per line hash collects the sites that
carry it; sketches merge by aggregation.  Lines whose estimate is clearly above or below the
threshold are settled by it, lines near it get an exact distinct count.  A line on enough sites is
boilerplate and goes from every document but, if asked for, the first one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.text import NOT_SPACE, Shield, let, with_results
from themeflow.operators.staging import stage

#: A line on so many sites is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; the relative error of an estimate is about 1.04 / sqrt(2 ** it).
SKETCH_BITS = 12
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 6.0
_BLANKS = " \t\x0b\x0c\r"


#: Tables of lines are broadcast up to this many bytes; above, adaptive joins meet them by hash.
BROADCAST_BYTES = 32 << 20


def _shared(lines: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``lines`` (staged rows of two numbers), marked for broadcast where they are few.

    A line that every document holds then stays spread over the tasks that read it.
    """
    return F.broadcast(lines) if lines.count() * 24 <= broadcast_bytes else lines


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """Hash of a line without the blanks around it; null for a line without a word."""
    return F.when(
        F.rlike(line, F.lit(NOT_SPACE)), F.xxhash64(F.trim(line, F.lit(_BLANKS)))
    )


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``__id``, ``__hash`` (of the text), ``site``, ``pos`` and ``line``, all as hashes but pos."""
    return (
        docs.select(
            F.col(id_col).alias("__id"),
            F.xxhash64(F.col(text_col)).alias("__hash"),
            F.xxhash64(F.col(site_col).cast("string")).alias("__seed"),
            F.col(site_col).isNull().alias("__no_site"),
            F.posexplode(F.transform(text_lines(F.col(text_col)), line_hash)).alias("pos", "line"),
        )
        .filter(F.col("line").isNotNull())
        .select(
            "__id",
            "__hash",
            F.when(~F.col("__no_site"), F.col("__seed")).alias("site"),
            "pos",
            "line",
        )
    )


def spread_lines(
    seen: DataFrame,
    min_sites: int = MIN_SITES,
    sketch_bits: int = SKETCH_BITS,
    errors: float = ERRORS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Lines on ``min_sites`` sites or more: ``line`` and ``first_id``, their smallest document id.

    ``seen`` has ``__id``, ``site`` and ``line``.  A null site is no site.
    """
    # A line on that many sites occurs as often.  Sites of one task fold into one sketch before
    # the shuffle, so a line that every document holds is one row per task.
    sketched = seen.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(sketch_bits)).alias("sketch"), F.min("__id").alias("first_id")
    )
    estimated = stage(
        sketched.select("line", "first_id", F.hll_sketch_estimate("sketch").alias("sites")).filter(
            F.col("sites") >= _low(min_sites, sketch_bits, errors)
        ),
        "line-spread",
    )
    high = _high(min_sites, sketch_bits, errors)
    near = estimated.filter(F.col("sites") < high).select("line")
    exact = (
        seen.join(_shared(near, broadcast_bytes), "line", "left_semi")
        .filter(F.col("site").isNotNull())
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("*").alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
        .select("line")
    )
    return stage(
        estimated.filter(F.col("sites") >= high)
        .select("line", "first_id")
        .unionByName(estimated.join(exact, "line").select("line", "first_id")),
        "boilerplate-lines",
    )


def _low(min_sites: int, sketch_bits: int, errors: float) -> int:
    return math.floor(min_sites * (1 - errors * 1.04 / math.sqrt(1 << sketch_bits)))


def _high(min_sites: int, sketch_bits: int, errors: float) -> int:
    return math.ceil(min_sites * (1 + errors * 1.04 / math.sqrt(1 << sketch_bits))) + 1


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the positions ``drop``."""
    return let(
        text_lines(text),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop),
                lambda i: F.get(lines, i),
            ),
            "\n",
        ),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    keep_first: bool = True,
    sketch_bits: int = SKETCH_BITS,
    errors: float = ERRORS,
    removed_col: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without boilerplate lines; with ``removed_col``, the positions of removed lines.

    Lines count as equal without the blanks around them; lines without a word always stay.  With
    ``keep_first`` the document with the smallest id keeps its first copy of each line, so no line
    vanishes from the corpus.  Every row stays, a row whose lines all go with an empty text.
    A null text stays null.  Rows of null id keep none, and null ids are no first ones unless a
    line has no other.
    """
    shield = Shield(docs)
    docs, id_col, text_col, site_col = shield.docs, *map(shield.name, (id_col, text_col, site_col))
    seen = stage(occurrences(docs, id_col, text_col, site_col), "lines")
    spread = spread_lines(seen, min_sites, sketch_bits, errors, broadcast_bytes)
    hits = seen.join(_shared(spread, broadcast_bytes), "line")
    if keep_first:
        mine = F.col("__id") == F.col("first_id")
        first = (
            hits.filter(mine)
            .groupBy("line", "__id", "__hash")
            .agg(F.min("pos").alias("pos"))
            .groupBy("line")
            .agg(F.min(F.struct("__hash", "pos")).alias("kept"))
        )
        hits = hits.join(first, "line", "left").filter(
            F.col("kept").isNull()
            | ~F.coalesce(mine, F.lit(False))
            | (F.col("__hash") != F.col("kept.__hash"))
            | (F.col("pos") != F.col("kept.pos"))
        )
    drops = hits.groupBy("__id", "__hash").agg(F.collect_set("pos").alias("__drop"))
    joined = with_results(docs, drops, id_col, text_col, F.size("__drop") * 4 + 64, broadcast_bytes)
    removed = F.coalesce(F.array_sort("__drop"), F.array().cast("array<int>"))
    out = joined.withColumn(
        text_col,
        F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(
            without_lines(F.col(text_col), F.col("__drop"))
        ),
    )
    extra = [removed.alias(removed_col)] if removed_col else []
    return shield.back(out.select(*[c for c in docs.columns if c != removed_col], *extra))
