"""Lexicon sentiment of posts and themes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import (
    BEARISH_BELOW, BULLISH_ABOVE, HITS_FOR_FULL_SCORE, MAX_KEYWORDS, NEGATIONS, NEGATIVE_WORDS,
    POSITIVE_WORDS, SATURATION_SHARE, SENTIMENT_SHARE, VELOCITY_SHARE,
)
from themeflow.functions.core import exact_round, let, order_in_post, post_order
from themeflow.functions.text import sentiment_tokens
from themeflow.operators.ranking import first_per_group
from themeflow.operators.staging import stage

# Scores have four decimals and weights two, so whole numbers hold both without error and their
# sums do not depend on the order of addition.
SCORE_UNITS = 10_000
WEIGHT_UNITS = 100


@dataclass(frozen=True)
class Lexicon:
    """Word lists; an empty list means the default one."""

    positive: Iterable[str] = ()
    negative: Iterable[str] = ()

    @property
    def positive_words(self) -> list[str]:
        return sorted(self.positive or POSITIVE_WORDS)

    @property
    def negative_words(self) -> list[str]:
        return sorted(self.negative or NEGATIVE_WORDS)


DEFAULT_LEXICON = Lexicon()
#: A lexicon table is broadcast up to this many bytes; above, words meet it in a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class LexiconTable:
    """Word lists of any size: ``words`` has ``token`` and ``sign`` (1 or -1), one row per word."""

    words: DataFrame
    small: bool

    def signs(self) -> DataFrame:
        return F.broadcast(self.words) if self.small else self.words


def lexicon_table(words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> LexiconTable:
    """Lexicon from a table ``word, polarity`` (1 or -1, others are no entries).

    A word of both polarities counts as positive.  A polarity without any word has the default words,
    as an empty list has.
    """
    spark = words.sparkSession
    signs = words.select(F.lower("word").alias("token"), F.signum("polarity").cast("int").alias("sign"))
    signs = stage(signs.filter(F.col("token").isNotNull() & F.col("sign").isin(1, -1)).distinct(), "lexicon-entries")
    has = signs.agg(F.count_if(F.col("sign") > 0).alias("up"), F.count_if(F.col("sign") < 0).alias("down")).first()
    filling = [(w, 1) for w in POSITIVE_WORDS if not has["up"]] + [(w, -1) for w in NEGATIVE_WORDS if not has["down"]]
    if filling:
        signs = signs.unionByName(spark.createDataFrame(filling, "token string, sign int"))
    table = stage(signs.groupBy("token").agg(F.max("sign").alias("sign")), "lexicon")
    size = table.agg(F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0))).first()[0]
    return LexiconTable(table, size <= broadcast_bytes)


def _polarity(token: Column, previous: Column, lexicon: Lexicon) -> Column:
    """1 positive, -1 negative, 0 neither; a negation right before the word flips it.

    A word in both lists counts as positive.  Most words are in neither, so the first test
    settles them.
    """
    words = sorted({*lexicon.positive_words, *lexicon.negative_words})
    sign = F.when(token.isin(lexicon.positive_words), F.lit(1)).otherwise(F.lit(-1))
    return F.when(
        token.isin(words), F.when(previous.isin(*NEGATIONS), -sign).otherwise(sign)
    ).otherwise(F.lit(0))


def sentiment_hits(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Struct of ``positive_hits`` and ``negative_hits``."""

    def polarities(tokens: Column) -> Column:
        return F.transform(tokens, lambda token, i: _polarity(token, F.get(tokens, i - 1), lexicon))

    return let(
        let(sentiment_tokens(text), polarities),
        lambda found: F.struct(
            F.size(F.filter(found, lambda value: value == 1)).cast("long").alias("positive_hits"),
            F.size(F.filter(found, lambda value: value == -1)).cast("long").alias("negative_hits"),
        ),
    )


def term_hits(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Array of ``(token, polarity, position)`` of the words that count."""

    def found(tokens: Column) -> Column:
        return F.transform(
            tokens,
            lambda token, i: F.struct(
                token.alias("token"),
                _polarity(token, F.get(tokens, i - 1), lexicon).alias("polarity"),
                i.alias("position"),
            ),
        )

    return F.filter(let(sentiment_tokens(text), found), lambda word: word["polarity"] != 0)


def hits_score(positive: Column, negative: Column) -> Column:
    hits = positive + negative
    balance = (positive - negative) / F.nullif(hits, F.lit(0))
    damping = F.least(F.lit(1.0), hits / F.lit(HITS_FOR_FULL_SCORE))
    return F.coalesce(exact_round(balance * damping, 4), F.lit(0.0))


def label(score: Column) -> Column:
    return (
        F.when(score > BULLISH_ABOVE, F.lit("bullish"))
        .when(score < BEARISH_BELOW, F.lit("bearish"))
        .otherwise(F.lit("neutral"))
    )


def _token_rows(posts: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of each post with each ``token``, its ``position`` and whether a negation stands before it."""

    def placed(tokens: Column) -> Column:
        return F.transform(
            tokens,
            lambda token, i: F.struct(
                token.alias("token"),
                i.alias("position"),
                F.coalesce(F.get(tokens, i - 1).isin(*NEGATIONS), F.lit(False)).alias("negated"),
            ),
        )

    # Two selects: columns selected next to an explode are evaluated once per exploded row.  Outer,
    # because the inner form filters on the size at the scan and splits each text twice.
    found = posts.select(*columns, let(sentiment_tokens("text"), placed).alias("found"))
    rows = found.select(*found.columns[:-1], F.inline_outer("found"))
    return rows.filter(F.col("token").isNotNull())


def table_hits(posts: DataFrame, lexicon: LexiconTable) -> DataFrame:
    """``id, positive_hits, negative_hits`` of the posts with a hit; ids are unique.

    Each word with the one before it meets the table, and hits are summed by post.  Words of a small
    table are broadcast, so no word is shuffled; of a large one, adaptive execution splits the
    most frequent words.
    """
    met = _token_rows(posts, "id").select("id", "token", "negated").join(lexicon.signs(), "token")
    polarity = F.when(F.col("negated"), -F.col("sign")).otherwise(F.col("sign"))
    return met.groupBy("id").agg(
        F.count_if(polarity == 1).alias("positive_hits"), F.count_if(polarity == -1).alias("negative_hits")
    )


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` (with a unique ``id``) and their hits; none where ``hits`` has no row."""
    none = F.lit(0).cast("long")
    return rows.join(hits, "id", "left").withColumns(
        {name: F.coalesce(name, none) for name in ("positive_hits", "negative_hits")}
    )


def with_scores(rows: DataFrame) -> DataFrame:
    """Add ``score`` and ``label`` to rows with hits."""
    scored = rows.withColumn("score", hits_score(F.col("positive_hits"), F.col("negative_hits")))
    return scored.withColumn("label", label(F.col("score")))


def with_sentiment(posts: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add ``score, positive_hits, negative_hits, label`` to posts."""
    return with_scores(
        posts.withColumn("_hits", sentiment_hits("text", lexicon))
        .withColumns(
            {
                "positive_hits": F.col("_hits.positive_hits"),
                "negative_hits": F.col("_hits.negative_hits"),
            }
        )
        .drop("_hits")
    )


def scored(posts: DataFrame, lexicon: Lexicon | LexiconTable, *columns: Column | str) -> DataFrame:
    """``columns`` of posts with their hits, score and label; texts stay where they are."""
    if isinstance(lexicon, LexiconTable):
        return with_scores(with_hits(posts.select("id", *columns), table_hits(posts, lexicon)))
    found = with_sentiment(posts, lexicon)
    return found.select("id", *columns, "positive_hits", "negative_hits", "score", "label")


def score_posts(posts: DataFrame, lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON) -> DataFrame:
    return scored(posts, lexicon).select("id", "positive_hits", "negative_hits", "score", "label")


def engagement_weight() -> Column:
    """Between 0 and 2; negative counts are ignored."""
    return weight_units() / F.lit(WEIGHT_UNITS) - 1


def weight_units() -> Column:
    """One plus the engagement weight, in hundredths."""
    floored = sum((F.greatest(F.lit(0), F.col(name)) for name in ("likes", "replies", "reposts")), F.lit(0))
    return F.lit(WEIGHT_UNITS) + F.least(F.lit(2 * WEIGHT_UNITS), floored)


def score_units(score: Column) -> Column:
    return F.round(score * SCORE_UNITS).cast("long")


def weighted_score(weighted: Column, weights: Column) -> Column:
    """Mean score from the two whole-number sums; 0 when there is nothing to average."""
    mean = weighted / F.nullif(weights, F.lit(0)) / F.lit(SCORE_UNITS)
    return F.coalesce(exact_round(mean, 4), F.lit(0.0))


def theme_sentiment(
    narratives: DataFrame, membership: DataFrame, posts: DataFrame,
    lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON,
) -> DataFrame:
    """``narrative_id, score, label, sample_size`` for any membership.

    Ids without a post are skipped, repeated ids count each time.  Both sides of the join are
    spread by post id; the sums are combined before they are shuffled by theme.
    """
    units = scored(posts, lexicon, weight_units().alias("weight")).select(
        F.col("id").alias("post_id"), "weight", score_units(F.col("score")).alias("units")
    )
    sums = (
        membership.join(units, "post_id")
        .groupBy("narrative_id")
        .agg(
            F.sum(F.col("units") * F.col("weight")).alias("weighted"),
            F.sum("weight").alias("weights"),
            F.count("*").alias("sample_size"),
        )
    )
    score = weighted_score(F.col("weighted"), F.col("weights"))
    return (
        narratives.select(F.col("id").alias("narrative_id"))
        .join(sums, "narrative_id", "left")
        .select("narrative_id", score.alias("score"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))
        .withColumn("label", label(F.col("score")))
    )


def overall_score(sentiment: Column, velocity: Column, saturation: Column) -> Column:
    return exact_round(
        sentiment * SENTIMENT_SHARE + velocity * VELOCITY_SHARE + saturation * SATURATION_SHARE, 4
    )


def apply_sentiment(
    narratives: DataFrame, membership: DataFrame, posts: DataFrame,
    lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON,
) -> DataFrame:
    """Fill ``sentiment_score`` and ``overall_score``."""
    sentiment = theme_sentiment(narratives, membership, posts, lexicon).select(
        F.col("narrative_id").alias("id"), F.col("score").alias("_score")
    )
    return (
        narratives.join(sentiment, "id")
        .withColumn("sentiment_score", F.col("_score"))
        .withColumn(
            "overall_score",
            overall_score(F.col("_score"), F.col("velocity_score"), F.col("saturation_score")),
        )
        .drop("_score")
    )


def top_terms(
    posts: DataFrame, limit: int = MAX_KEYWORDS, lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON
) -> DataFrame:
    """Most frequent words counted as positive and as negative: ``side, rank, token, n``."""
    first_met = F.min(order_in_post(F.col("post_order"), F.col("position"))).alias("first_met")
    if isinstance(lexicon, LexiconTable):
        # Words are counted before they meet the table: one row per word, however frequent.
        words = _token_rows(posts, post_order().alias("post_order")).groupBy("token", "negated")
        met = words.agg(F.count("*").alias("n"), first_met).join(lexicon.signs(), "token")
        polarity = F.when(F.col("negated"), -F.col("sign")).otherwise(F.col("sign"))
        counted = met.select(polarity.alias("polarity"), "token", "n", "first_met")
    else:
        # Two selects: columns selected next to an explode are evaluated once per exploded row.
        found = posts.select(post_order().alias("post_order"), term_hits("text", lexicon).alias("found"))
        # Outer, because the inner form filters on the size at the scan and splits each text twice.
        rows = found.select("post_order", F.inline_outer("found")).filter(F.col("token").isNotNull())
        counted = rows.groupBy("polarity", "token").agg(F.count("*").alias("n"), first_met)
    ranked = first_per_group(
        counted, ["polarity"], [F.desc("n"), "first_met", "token"], limit, "token", "rank"
    )
    side = F.when(F.col("polarity") == 1, F.lit("positive")).otherwise(F.lit("negative"))
    return ranked.select(side.alias("side"), "rank", "token", "n")
