"""Text functions.  All are built-in expressions and run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeflow.constants import (
    BLANK, CASHTAG, HASHTAG, KEYWORD, MARKUP, SENTIMENT_WORD, STOPWORDS, URL,
)
from themeflow.functions.core import col, let, strip


def _all_matches(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def cashtags(text: Column | str) -> Column:
    return _all_matches(text, CASHTAG, 1)


def hashtags(text: Column | str) -> Column:
    return _all_matches(text, HASHTAG, 1)


def urls(text: Column | str) -> Column:
    return _all_matches(text, URL, 0)


def keyword_tokens(text: Column | str) -> Column:
    """Lower-cased words of three or more characters without stopwords, in text order."""
    words = _all_matches(F.lower(col(text)), KEYWORD, 0)
    return F.filter(words, lambda word: ~word.isin(*STOPWORDS))


def sentiment_tokens(text: Column | str) -> Column:
    """Words of two or more characters, lower-cased after matching.

    Lower-casing the text first is one pass instead of one call per word.  It is the same for
    all but the two characters that turn into Latin letters, so those become blanks before.
    """
    plain = F.replace(F.replace(col(text), F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))
    return _all_matches(F.lower(plain), SENTIMENT_WORD, 0)


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(rf"[^{BLANK}]+")), F.lit(0)).cast("long")


def contains_any(text: Column | str, keywords: Sequence[str]) -> Column:
    """Case-insensitive substring test; true when no keywords are asked for."""
    if not keywords:
        return F.lit(True)
    needles = F.array(*[F.lit(keyword.lower()) for keyword in keywords])
    return let(F.lower(col(text)), lambda hay: F.exists(needles, lambda word: hay.contains(word)))


def upper_tags(tags: Column | str) -> Column:
    """Non-empty tags in upper case; order and repeats are kept."""
    kept = F.filter(F.coalesce(col(tags), F.array().cast("array<string>")), lambda tag: tag != "")
    return F.transform(kept, F.upper)


def dominant_word(words: Column) -> Column:
    """Most frequent word; of equally frequent words the one met first.  Null when empty.

    Sorting brings equal words together, so run lengths give the counts in n log n.  Counting
    each distinct word separately would be quadratic in long texts.
    """

    def longest_runs(first_met: Column) -> Column:
        return let(
            F.sort_array(first_met),
            lambda ordered: let(
                F.filter(
                    F.sequence(F.lit(0), F.size(ordered) - 1),
                    lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
                ),
                lambda starts: let(
                    F.transform(
                        starts,
                        lambda start, j: F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start,
                    ),
                    lambda lengths: let(
                        F.array_max(lengths),
                        lambda longest: F.transform(
                            F.filter(starts, lambda _, j: F.get(lengths, j) == longest),
                            lambda start: F.get(ordered, start),
                        ),
                    ),
                ),
            ),
        )

    # array_intersect keeps the order of its first argument.
    return let(
        words,
        lambda bound: F.when(
            F.size(bound) > 0, F.get(F.array_intersect(bound, longest_runs(bound)), F.lit(0))
        ),
    )


def markup_to_text(markup: Column | str) -> Column:
    """Tags become blanks, blanks collapse to single spaces, ends are trimmed."""
    spaced = F.regexp_replace(col(markup), MARKUP, " ")
    return F.trim(F.regexp_replace(spaced, rf"[{BLANK}]+", " "))


def join_paragraphs(parts: Column) -> Column:
    """Strip the non-empty parts and join them with a blank line.

    A part of blanks only is non-empty before stripping, so it still adds its separator.
    """
    kept = F.filter(parts, lambda part: part.isNotNull() & (part != ""))
    return F.array_join(F.transform(kept, strip), "\n\n")


def title_case(word: Column | str) -> Column:
    """Upper-case each letter that does not follow a letter, as in ``Etf2Inflow``."""
    return let(
        F.split(col(word), ""),
        lambda chars: F.array_join(
            F.transform(
                chars,
                lambda char, i: F.when(
                    (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(char)
                ).otherwise(F.lower(char)),
            ),
            "",
        ),
    )
