"""Packing into optimal length buckets.

The histogram of sequence lengths over all documents is bounded by the longest allowed sequence, so
the driver can choose the bucket boundaries that minimise padding by dynamic programming.  Inside
a bucket all sequences are padded to one length, and batches hold as many as the token budget
allows.  Sequences are numbered without a global sort: counts of fixed cells give each cell its
offset, and a window numbers the rows inside a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeflow.llm.text import NOT_SPACE
from themeflow.operators.staging import stage

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 65_536
#: Cells of a bucket: as many as hexadecimal digits of the digest allow.
CELL_DIGITS = 3


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` lengths, the last the longest, with the least padding in total.

    Sequences are padded to the smallest boundary that holds them.  Exact: for each number of
    buckets the best split of every prefix is found by divide and conquer (best splits never move
    left), in O(buckets * n log n) for n distinct lengths.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    n = len(lengths)
    if not n:
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    # Python integers: sums of a large corpus must not overflow in products.
    rows = [0, *(int(x) for x in np.cumsum(counts))]
    tokens = [0]
    for length, count in zip(lengths.tolist(), counts.tolist()):
        tokens.append(tokens[-1] + length * count)
    tops = lengths.tolist()

    def cost(i: int, j: int) -> int:
        """Padding of lengths i..j-1 padded to the last of them."""
        return tops[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    best = [0] + [cost(0, j) for j in range(1, n + 1)]
    choice: list[list[int]] = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, cut = [0] * (n + 1), [0] * (n + 1)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            value, at = min(
                (best[i] + cost(i, middle), i) for i in range(first, min(last, middle - 1) + 1)
            )
            new[middle], cut[middle] = value, at
            todo += [(low, middle - 1, first, at), (middle + 1, high, at, last)]
        best = new
        choice.append(cut)
    out, j = [], n
    for cut in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = cut[j]
    return sorted(set(out))


@dataclass(frozen=True)
class Plan:
    """Boundaries and what they cost, from the histogram of all sequences."""

    lengths: list[int]
    tokens: int
    padding: int


def plan(histogram: dict[int, int], buckets: int = BUCKETS) -> Plan:
    lengths = boundaries(histogram, buckets)
    padding = sum(
        (next(b for b in lengths if b >= k) - k) * v for k, v in histogram.items() if v > 0
    )
    return Plan(lengths, sum(k * v for k, v in histogram.items()), padding)


def word_tokens(text: Column) -> Column:
    """Words and one end token; the default length of a document."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)) + 1


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_tokens: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> tuple[DataFrame, Plan]:
    """One row per sequence with its batch, and the plan.

    ``n_tokens`` is the length of a document (default: words of ``text_col`` and an end token).
    Longer documents than ``max_tokens`` become several sequences: ``piece`` counts them,
    ``start`` is the first token of each.  Columns: ``id_col``, ``piece``, ``start``,
    ``seq_tokens``, ``bucket`` (from 0), ``padded_to``, ``batch`` and ``slot`` (from 0 in each
    bucket).  A batch holds at most ``budget // padded_to`` sequences; all but the last of a bucket
    are full.  The order inside a bucket is that of a digest of the id, so neighbours in the input
    are apart.  A null text has its end token alone; null or negative lengths count as 0 and an
    empty sequence is still a row.  Repeated rows are separate sequences.
    """
    if budget < max_tokens:
        raise ValueError("the budget must hold a sequence of max_tokens")
    length = word_tokens(F.col(text_col)) if n_tokens is None else n_tokens
    total = docs.select(
        F.col(id_col).alias("__id"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("__n"),
    )
    pieces = F.greatest(F.ceil(F.col("__n") / max_tokens), F.lit(1)).cast("int")
    sequences = stage(
        total.select("__id", "__n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select(
            "__id",
            "piece",
            (F.col("piece").cast("long") * max_tokens).alias("start"),
            F.least(
                F.col("__n") - F.col("piece").cast("long") * max_tokens, F.lit(max_tokens)
            )
            .cast("int")
            .alias("seq_tokens"),
            F.md5(F.coalesce(F.col("__id").cast("string"), F.lit(""))).alias("__digest"),
        ),
        "sequences",
    )
    counted = sequences.groupBy("seq_tokens").count().collect()  # max_tokens + 1 rows at most
    chosen = plan({r["seq_tokens"]: r["count"] for r in counted}, buckets)
    bounds = chosen.lengths or [0]
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("seq_tokens")))
    placed = (
        sequences.withColumn("bucket", bucket)
        .withColumn("padded_to", F.get(F.array(*[F.lit(b) for b in bounds]), F.col("bucket")))
        .withColumn("__cell", F.conv(F.substring("__digest", 1, CELL_DIGITS), 16, 10).cast("int"))
    )
    # 16 ** CELL_DIGITS cells a bucket at most, whatever the size of the corpus.
    before = Window.partitionBy("bucket").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "__cell")
        .agg(F.count("*").alias("__size"))
        .select("bucket", "__cell", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy("bucket", "__cell").orderBy("__digest", "__id", "piece")
    numbered = placed.join(F.broadcast(offsets), ["bucket", "__cell"]).withColumn(
        "__place", F.col("__offset") + F.row_number().over(inside) - 1
    )
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))), F.lit(1))
    return (
        numbered.select(
            F.col("__id").alias(id_col),
            "piece",
            "start",
            "seq_tokens",
            "bucket",
            "padded_to",
            F.floor(F.col("__place") / room).cast("long").alias("batch"),
            F.pmod(F.col("__place"), room).cast("int").alias("slot"),
        ),
        chosen,
    )


def padding_share(chosen: Plan) -> float:
    """Padding as a share of all padded tokens."""
    whole = chosen.tokens + chosen.padding
    return chosen.padding / whole if whole else math.nan
