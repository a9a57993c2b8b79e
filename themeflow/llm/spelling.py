"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced code point changes the squared distance of two words' letter
counts by at most two, so a NumPy product of the letter counts of a block gives every pair worth an
exact check.  Blocks keep the products small: an edit lies in one half of a word, so the two words
share the other half.  A block holds the words of one length and those one longer that share such
a half; a crowded block is cut again at the middle of the half that is still open, until it fits or
one open code point is left.  Every pair of near words meets in exactly one block, whatever the
number of words, and no block becomes all its pairs.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.text import lower_ascii
from themeflow.operators.staging import stage

#: Blocks of more rows are cut again.
CROWD = 1024
#: Rows that one task takes at a time, on average.
BIN_ROWS = 16_384
#: Rows of one matrix product, unless one block has more.
_PRODUCT_ROWS = 512
#: Code points are counted in so many columns at most; more distinct ones share columns, which can only add candidates.
_COLUMNS = 128
#: Code points of candidate pairs that are compared at a time.
_CELLS = 2_000_000
#: Crowded block keys are broadcast up to this number (8 bytes each).
BROADCAST_KEYS = 1_000_000

RUN = "[a-zÀ-ÿ]"


def damaged(run: Column, seed: Column, every: int) -> Column:
    """``run`` without one code point where ``every`` divides the checksum of ``seed``, a ``:`` and the run."""
    check = F.crc32(F.concat(seed, F.lit(":"), run))
    at = (check % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(check % every == 0, cut).otherwise(run)


def counted_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2,
    damage_every: int | None = 31,
) -> DataFrame:
    """``word`` and ``n`` of the words of all texts, A to Z in lower case.

    Words are maximal runs of letters up to U+00FF; those of fewer than ``min_chars`` code points or
    ``min_count`` occurrences are left out.  ``damage_every`` plants typing errors that depend on
    the document and the word alone; ``None`` plants none.  A null text has no words, a null id is
    an empty text in the checksum, and repeated rows count as often as they stand there.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(f"({RUN}{{{min_chars},}})"), 1)
    seed = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.select(seed.alias("seed"), F.explode(runs).alias("word"))
    if damage_every:
        word = damaged(F.col("word"), F.col("seed"), damage_every)
        found = found.select(word.alias("word")).filter(F.char_length("word") >= min_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _region(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (``word``, ``n``, ``length``, ``region``) with the block they belong to.

    ``length`` is that of the shorter words of the block, the region the code points of theirs that
    may differ.  What lies before and behind is the key.
    """
    before = F.substring(F.col("word"), F.lit(1), F.col("region.first"))
    behind = F.when(
        F.col("region.last") < F.col("length"), F.expr("right(word, length - region.last)")
    ).otherwise("")
    key = F.xxhash64("length", "region.first", "region.last", before, behind)
    return rows.select("word", "n", "length", "region", key.alias("key"))


def _halves(first: Column, last: Column) -> Column:
    middle = F.floor((first + last) / 2)
    return F.array(_region(first, middle), _region(middle, last))


def _first_blocks(words: DataFrame) -> DataFrame:
    """Each word as the shorter one and as the longer one of a pair, with each half open."""
    roles = words.select(
        "word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("length")
    ).filter(F.col("length") > 0)
    halves = F.when(F.col("length") > 1, _halves(F.lit(0), F.col("length"))).otherwise(
        F.array(_region(F.lit(0), F.col("length")))
    )
    return _in_blocks(roles.withColumn("region", F.explode(halves)))


def _pairs_of(code: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the edit that turns word ``a`` into word ``b``, as long or one longer; -1 where one edit does not."""
    place = np.full(len(a), -1)
    order = np.argsort(size[b], kind="stable")
    at = 0
    while at < len(order):
        # Words are sorted by length: those of this slice are at most as long as its last one.
        width = int(size[b[order[at]]]) + 1
        end = at + max(1, _CELLS // width)
        while end - at > 1 and (int(size[b[order[min(end, len(order)) - 1]]]) + 1) * (end - at) > 2 * _CELLS:
            end = at + (end - at) // 2
        chosen = order[at:end]
        width = int(size[b[chosen]].max()) + 1
        columns = np.arange(width)

        def padded(rows: np.ndarray) -> np.ndarray:
            inside = columns < size[rows][:, None]
            return np.where(inside, code[np.minimum(start[rows][:, None] + columns, len(code) - 1)], 0)

        one, two = padded(a[chosen]), padded(b[chosen])
        differ = one != two
        first = differ.argmax(axis=1)
        replaced = differ.sum(axis=1) == 1
        shifted = (one[:, :-1] != two[:, 1:]) & (columns[:-1] >= first[:, None])
        near = np.where(size[a[chosen]] == size[b[chosen]], replaced, ~shifted.any(axis=1))
        place[chosen] = np.where(near & differ.any(axis=1), first, -1)
        at = end
    return place


_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64())])


def _near_in_bin(table: pa.Table) -> pa.Table:
    """Near pairs of the blocks of one bin; ``a`` is the shorter word of a pair."""
    key, length = table["key"].to_numpy(), table["length"].to_numpy()
    size = np.fromiter(map(len, table["word"].to_pylist()), np.int64, table.num_rows)
    longer = size > length
    order = np.lexsort((longer, key))
    edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
    # Blocks without a shorter word or of one word have no pairs; shorter words come first in their block.
    counts = np.diff(edges)
    order = order[np.repeat((counts > 1) & ~longer[order[edges[:-1]]], counts)]
    if not len(order):
        return _PAIRS.empty_table()

    table, key, length, size, longer = table.take(order), key[order], length[order], size[order], longer[order]
    words = table["word"].to_pylist()
    region = table["region"].combine_chunks()
    open_from, open_to = region.field(0).to_numpy(), region.field(1).to_numpy()
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.r_[0, np.cumsum(size)]
    points, column = np.unique(code, return_inverse=True)
    width = min(len(points), _COLUMNS)
    cell = np.repeat(np.arange(len(words)), size) * width + column % width
    kind = np.float32 if size.max() < 2_000 else np.float64  # squares stay whole numbers
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    found_a, found_b, begin = [], [], 0
    while begin < len(edges) - 1:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + _PRODUCT_ROWS, "right")) - 1)
        low, high = edges[begin], edges[end]
        letters = np.bincount(cell[start[low] : start[high]] - low * width, minlength=(high - low) * width)
        letters = letters.reshape(high - low, width).astype(kind)
        norm = (letters * letters).sum(axis=1)
        short = np.flatnonzero(~longer[low:high])
        squared = norm[short][:, None] + norm[None, :] - 2 * (letters[short] @ letters.T)
        wanted = (squared <= 2) & (key[low + short][:, None] == key[None, low:high])
        wanted &= longer[None, low:high] | (np.arange(high - low)[None, :] > short[:, None])
        i, j = np.nonzero(wanted)
        found_a.append(low + short[i])
        found_b.append(low + j)
        begin = end
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    same = (length[a] == length[b]) & (open_from[a] == open_from[b]) & (open_to[a] == open_to[b])
    a, b = a[same], b[same]
    place = _pairs_of(code, start[:-1], size, a, b)
    # The region of the edit alone reports the pair; behind the last code point belongs to the last region.
    inside = (place >= open_from[a]) & ((place < open_to[a]) | ((place == open_to[a]) & (place == length[a])))
    a, b = a[inside], b[inside]
    word, n = table["word"], table["n"]
    return pa.Table.from_arrays([word.take(a), word.take(b), n.take(a), n.take(b)], schema=_PAIRS)


def _near_in_blocks(rows: DataFrame, n_rows: int, bin_rows: int) -> DataFrame:
    bins = max(1, math.ceil(n_rows / bin_rows))
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(_near_in_bin, "a string, b string, n_a long, n_b long")


def near_pairs(words: DataFrame, crowd: int = CROWD, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``a``, ``b``, ``n_a``, ``n_b``: each pair of words one edit apart, once; ``a`` isn't the longer one.

    ``words`` has distinct non-null ``word`` and its ``n``.
    """
    spark = words.sparkSession
    rows, found = _first_blocks(words), []
    n_rows = 4 * words.count()
    while True:
        crowded = stage(
            rows.groupBy("key").agg(
                F.count("*").alias("rows"), F.max(F.col("region.last") - F.col("region.first")).alias("open")
            ).filter((F.col("rows") > crowd) & (F.col("open") > 1)).select("key", "rows"),
            "crowded-blocks",
        )
        n_keys, n_crowded = crowded.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        keys = F.broadcast(crowded.select("key")) if n_keys <= BROADCAST_KEYS else crowded.select("key")
        few = rows.join(keys, "key", "left_anti") if n_keys else rows
        found.append(stage(_near_in_blocks(few, n_rows - n_crowded, bin_rows), "near-words"))
        if not n_keys:
            break
        halves = _halves(F.col("region.first"), F.col("region.last"))
        # A hash that two blocks share may hold one that can't be cut any more: it goes on as it is.
        halves = F.when(F.col("region.last") - F.col("region.first") > 1, halves).otherwise(F.array("region"))
        cut = rows.join(keys, "key", "left_semi").select("word", "n", "length", F.explode(halves).alias("region"))
        rows = stage(_in_blocks(cut), "cut-blocks")
        n_rows = 2 * n_crowded
    schema = found[0].schema
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionByName(part)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms; each round doubles the steps taken.

    Forms are ten times as frequent as their word, so chains are short and have no cycles.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        step = stage(step, "word-roots")
        reached = step.select("word", "root")
        if step.filter("next is not null").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = 10, crowd: int = CROWD, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of each word.

    ``words`` has distinct non-null words and their counts.  ``form`` is the most frequent near word (of
    equal ones, the first by code points) if it is at least ``ratio`` times as frequent, else null;
    ``root`` ends the chain of forms.  No words, no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = stage(words.select("word", "n"), "words")
    pairs = near_pairs(words, crowd, bin_rows)
    ways = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
            )
        ).alias("way")
    ).select("way.*")
    near = ways.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    strong = -F.col("best.less") >= ratio * F.col("n")
    known = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2,
    damage_every: int | None = 31, ratio: int = 10,
) -> DataFrame:
    """The variants of all words of ``docs``; see ``counted_words`` and ``variants``."""
    return variants(counted_words(docs, id_col, text_col, min_chars, min_count, damage_every), ratio)
