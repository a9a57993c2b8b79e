"""Statistics of a text as Spark expressions, shared by the quality operators.

Each text is split once.  Words are runs without ASCII white space; a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.text import NOT_SPACE, let, words

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_exclaim",
    "n_pipes",
    "n_distinct_words",
]
#: Derived from the counts; what classifiers and rules look at.
RATIOS = [
    "log_words",
    "mean_word_chars",
    "symbol_ratio",
    "dup_line_ratio",
    "repeat_ratio",
    "words_per_line",
    "upper_ratio",
    "digit_ratio",
    "exclaim_ratio",
    "pipe_ratio",
    "distinct_ratio",
]


def repeat_words(w: Column) -> Column:
    """Words of ``w`` inside a 3-word window that stands twice or more in it, the first included.

    Window hashes with the position in the low bits are sorted as plain longs; windows whose high
    bits equal a neighbour's are candidates, and candidates are then compared by their words.
    """
    n = F.size(w) - 2
    bits = F.when(n < (1 << 24), F.lit(24)).otherwise(F.lit(40))
    keys = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.call_function(
            "shiftleft",
            F.call_function(
                "shiftright", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits
            ),
            bits,
        ).bitwiseOR(i.cast("long")),
    )

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def candidates(s: Column) -> Column:
        near = F.filter(
            s,
            lambda x, j: F.coalesce(high(x) == high(F.get(s, j + 1)), F.lit(False))
            | F.coalesce(high(x) == high(F.get(s, j - 1)), F.lit(False)),
        )
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.transform(near, lambda x: x.bitwiseAND(mask).cast("int"))

    def named(positions: Column) -> Column:
        return F.array_sort(
            F.transform(
                positions,
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"),
                    i.alias("i"),
                ),
            )
        )

    def twice(s: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, j: F.coalesce(x["t"] == F.get(s, j + 1)["t"], F.lit(False))
                    | F.coalesce(x["t"] == F.get(s, j - 1)["t"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        )

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    exact = let(F.sort_array(keys), candidates)
    counted = let(
        exact,
        lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(
            let(named(c), lambda s: let(twice(s), covered))
        ),
    )
    return F.when(n < 1, F.lit(0)).otherwise(counted)


def counts(text: Column) -> Column:
    """Struct of ``COUNTS``, all long."""
    safe = F.coalesce(text, F.lit(""))

    def of(w: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_repeat_words": repeat_words(w),
            "n_distinct_words": F.size(F.array_distinct(w)),
        }

    lines = F.filter(F.split(safe, "\n", -1), lambda line: F.rlike(line, F.lit(NOT_SPACE)))
    by_words = let(
        words(text), lambda w: F.struct(*[v.cast("long").alias(k) for k, v in of(w).items()])
    )
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )

    def count(pattern: str) -> Column:
        return F.regexp_count(safe, F.lit(pattern)).cast("long")

    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[!?]").alias("n_exclaim"),
        count(r"\|").alias("n_pipes"),
    )


def with_counts(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``COUNTS``."""
    raw = docs.select(*keep, counts(F.col(text_col)).alias("__c"))
    at = {
        name: F.col("__c")[group][name] if group else F.col("__c")[name]
        for name in COUNTS
        for group in [
            "w"
            if name in ("n_words", "word_chars", "n_repeat_words", "n_distinct_words")
            else "l"
            if name in ("n_lines", "n_dup_lines")
            else ""
        ]
    }
    return raw.select(*keep, *[at[name].alias(name) for name in COUNTS])


def ratios(prefix: str = "") -> dict[str, Column]:
    """``RATIOS`` from columns ``COUNTS``; 0 where nothing is to be divided."""

    def c(name: str) -> Column:
        return F.col(prefix + name).cast("double")

    def per(a: str, b: str) -> Column:
        return F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))

    return {
        "log_words": F.log1p(c("n_words")),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"),
        "exclaim_ratio": per("n_exclaim", "n_words"),
        "pipe_ratio": per("n_pipes", "n_words"),
        "distinct_ratio": per("n_distinct_words", "n_words"),
    }
