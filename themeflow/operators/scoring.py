"""Velocity and saturation of themes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import (
    AUTHOR_SHARE, DENSITY_SHARE, FREQUENCY_SHARE, FULL_AUTHORS, FULL_ENGAGEMENT_PER_POST,
    FULL_POSTS_PER_HOUR, FULL_SHARE_OF_VOICE, VOICE_SHARE,
)
from themeflow.functions.core import distinct_up_to, engagement, exact_round, hours_before
from themeflow.operators.sentiment import overall_score, weighted_score

WINDOW_HOURS = 24


def check_window(hours: int) -> None:
    if hours <= 0:
        raise ValueError("the velocity window must be longer than zero hours")


def velocity_score(posts: Column, total_engagement: Column, hours: int) -> Column:
    """Posts per hour and engagement per post, each capped; 0 without posts in the window."""
    frequency = F.least(F.lit(1.0), posts / F.lit(hours) / F.lit(FULL_POSTS_PER_HOUR))
    per_post = total_engagement / F.nullif(posts, F.lit(0))
    density = F.least(F.lit(1.0), per_post / F.lit(FULL_ENGAGEMENT_PER_POST))
    score = exact_round(frequency * FREQUENCY_SHARE + density * DENSITY_SHARE, 4)
    # ``least`` skips nulls, so an empty window needs its own case.
    return F.when(posts > 0, score).otherwise(F.lit(0.0))


def saturation_score(members: Column, authors: Column, all_posts: Column) -> Column:
    """Share of all posts and number of voices, each capped; 0 without any posts."""
    voice = members / F.nullif(all_posts, F.lit(0)) / F.lit(FULL_SHARE_OF_VOICE)
    diversity = F.least(F.lit(1.0), authors / F.lit(FULL_AUTHORS))
    score = F.least(F.lit(1.0), voice) * VOICE_SHARE + diversity * AUTHOR_SHARE
    return F.when(all_posts > 0, exact_round(score, 4)).otherwise(F.lit(0.0))


def _members_with_posts(membership: DataFrame, posts: DataFrame) -> DataFrame:
    # A theme is a set of posts here, so repeated ids count once.  Partitioned by post id, both
    # the distinct and the join find their rows in place: one shuffle of the membership.
    pairs = membership.select("narrative_id", "post_id").repartition("post_id").distinct()
    return pairs.join(posts.withColumnRenamed("id", "post_id"), "post_id")


def velocity(
    narratives: DataFrame, membership: DataFrame, posts: DataFrame,
    as_of: Column | datetime, hours: int = WINDOW_HOURS,
) -> DataFrame:
    """``id, velocity_score``; the window opens after ``as_of - hours`` and has no upper end."""
    check_window(hours)
    recent = posts.filter(F.col("created_at") > hours_before(as_of, hours)).select(
        "id", engagement().alias("engagement")
    )
    sums = (
        _members_with_posts(membership, recent)
        .groupBy("narrative_id")
        .agg(F.count("*").alias("n"), F.sum("engagement").alias("total"))
    )
    return (
        narratives.select("id")
        .join(sums.withColumnRenamed("narrative_id", "id"), "id", "left")
        .select(
            "id",
            velocity_score(F.coalesce("n", F.lit(0)), F.col("total"), hours).alias("velocity_score"),
        )
    )


def saturation(narratives: DataFrame, membership: DataFrame, posts: DataFrame) -> DataFrame:
    """``id, saturation_score``; ids without a post still count towards the share."""
    sizes = membership.groupBy("narrative_id").agg(F.count("*").alias("members"))
    authors = (
        _members_with_posts(membership, posts.select("id", "author_id"))
        .groupBy("narrative_id")
        .agg(distinct_up_to("author_id", int(FULL_AUTHORS)).alias("authors"))
    )
    all_posts = posts.agg(F.count("*")).scalar()
    return (
        narratives.select(F.col("id").alias("narrative_id"))
        .join(sizes, "narrative_id", "left")
        .join(authors, "narrative_id", "left")
        .select(
            F.col("narrative_id").alias("id"),
            saturation_score(
                F.coalesce("members", F.lit(0)), F.coalesce("authors", F.lit(0)), all_posts
            ).alias("saturation_score"),
        )
    )


def update_scores(
    narratives: DataFrame, membership: DataFrame, posts: DataFrame,
    as_of: Column | datetime, hours: int = WINDOW_HOURS,
) -> DataFrame:
    """Narratives with both scores filled from one join of members and posts."""
    check_window(hours)
    recent = F.col("created_at") > hours_before(as_of, hours)
    facts = posts.select("id", "author_id", engagement().alias("engagement"), recent.alias("recent"))
    # Pre-aggregating by author keeps the distinct count and all sums in one pass.
    by_author = (
        _members_with_posts(membership, facts)
        .groupBy("narrative_id", "author_id")
        .agg(
            F.count_if("recent").alias("n"),
            F.sum(F.when(F.col("recent"), F.col("engagement"))).alias("total"),
        )
    )
    sums = by_author.groupBy("narrative_id").agg(
        F.count("*").alias("authors"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    sizes = membership.groupBy("narrative_id").agg(F.count("*").alias("members"))
    all_posts = posts.agg(F.count("*")).scalar()
    scores = sizes.join(sums, "narrative_id", "left").withColumnRenamed("narrative_id", "id")
    zero = F.lit(0)
    return (
        narratives.drop("velocity_score", "saturation_score")
        .join(scores, "id", "left")
        .withColumns(
            {
                "velocity_score": velocity_score(F.coalesce("n", zero), F.col("total"), hours),
                "saturation_score": saturation_score(
                    F.coalesce("members", zero), F.coalesce("authors", zero), all_posts
                ),
            }
        )
        .drop("members", "authors", "n", "total")
    )


def score_members(
    narratives: DataFrame, membership: DataFrame, facts: DataFrame,
    as_of: Column | datetime, hours: int = WINDOW_HOURS,
) -> DataFrame:
    """Narratives with all four scores from one join of members and ``facts``.

    ``facts`` is what ``cluster.assign`` leaves of each post (staged): no text is read again.
    Repeated ids of a theme count each time in the sentiment and once elsewhere; ids without a
    post count towards the share of voice only.
    """
    check_window(hours)
    recent = F.col("created_at") > hours_before(as_of, hours)
    narrow = facts.select(
        F.col("id").alias("post_id"), "author_id", "engagement", "units", "weight", recent.alias("recent")
    )
    pairs = (
        membership.select("narrative_id", "post_id")
        .repartition("post_id")
        .groupBy("narrative_id", "post_id")
        .agg(F.count("*").alias("copies"))
    )
    by_author = (
        pairs.join(narrow, "post_id", "left")
        .groupBy("narrative_id", "author_id")
        .agg(
            F.sum("copies").alias("members"),
            F.count_if("recent").alias("n"),
            F.sum(F.when(F.col("recent"), F.col("engagement"))).alias("total"),
            F.sum(F.col("units") * F.col("weight") * F.col("copies")).alias("weighted"),
            F.sum(F.col("weight") * F.col("copies")).alias("weights"),
        )
    )
    sums = by_author.groupBy(F.col("narrative_id").alias("id")).agg(
        F.count("author_id").alias("authors"),
        *[F.sum(name).alias(name) for name in ("members", "n", "total", "weighted", "weights")],
    )
    zero = F.lit(0)
    velocity_ = velocity_score(F.coalesce("n", zero), F.col("total"), hours)
    saturation_ = saturation_score(
        F.coalesce("members", zero), F.coalesce("authors", zero), facts.agg(F.count("*")).scalar()
    )
    return (
        narratives.drop("sentiment_score", "velocity_score", "saturation_score", "overall_score")
        .join(sums, "id", "left")
        .withColumns(
            {
                "sentiment_score": weighted_score(F.col("weighted"), F.col("weights")),
                "velocity_score": velocity_,
                "saturation_score": saturation_,
            }
        )
        .withColumn(
            "overall_score",
            overall_score(F.col("sentiment_score"), F.col("velocity_score"), F.col("saturation_score")),
        )
        .drop("authors", "members", "n", "total", "weighted", "weights")
    )
