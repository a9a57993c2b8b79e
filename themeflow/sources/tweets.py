"""Tweets from landed search pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.functions.core import instant
from themeflow.functions.dates import parse_iso
from themeflow.operators.observed import Watch, keep


def engagement_rate(engagement: Column, impressions: Column) -> Column:
    """Null unless there are impressions."""
    return F.when(impressions > 0, engagement / impressions)


def normalise(pages: DataFrame, collected_at: Column | datetime, watch: Watch | None = None) -> DataFrame:
    """One row per tweet with all post and tweet columns, plus ``query`` and ``arrival``.

    The author is looked up among the users of the same page, so no join is needed.  Tweets
    without id, text or a readable date are dropped; a watch counts them as ``twitter``.
    """
    author_id = F.coalesce("tweet.author_id", F.lit(""))

    def with_username(tweet: Column) -> Column:
        same = F.filter("includes.users", lambda user: user["id"] == tweet["author_id"])
        # Of users listed twice the last one counts.
        username = F.try_element_at(same, F.lit(-1))["username"]
        return F.struct(tweet.alias("tweet"), username.alias("username"))

    # Authors are found before the explode, so that no row carries the users of its page.
    tweets = pages.select(
        "query", "page", F.posexplode(F.transform("data", with_username)).alias("position", "found")
    ).select("query", "page", "position", "found.*")

    def metric(name: str) -> Column:
        return F.coalesce(F.col(f"tweet.public_metrics.{name}"), F.lit(0))

    def tags(name: str, field: str) -> Column:
        return F.coalesce(
            F.col(f"tweet.entities.{name}.{field}"), F.array().cast("array<string>")
        )

    counted = metric("like_count") + metric("retweet_count") + metric("reply_count") + metric("quote_count")
    found = tweets.select(
        "query",
        F.struct("page", "position").alias("arrival"),
        F.col("tweet.id").alias("id"),
        F.lit("twitter").alias("platform"),
        author_id.alias("author_id"),
        F.coalesce("username", F.lit("unknown")).alias("author_username"),
        F.col("tweet.text").alias("text"),
        parse_iso("tweet.created_at").alias("created_at"),
        metric("like_count").alias("likes"),
        metric("reply_count").alias("replies"),
        metric("retweet_count").alias("reposts"),
        F.col("tweet.lang").alias("language"),
        tags("cashtags", "tag").alias("cashtags"),
        tags("hashtags", "tag").alias("hashtags"),
        tags("urls", "expanded_url").alias("urls"),
        instant(collected_at).alias("collected_at"),
        F.lit(False).alias("processed"),
        metric("impression_count").alias("impressions"),
        metric("quote_count").alias("quote_tweets"),
        metric("bookmark_count").alias("bookmarks"),
        engagement_rate(counted, metric("impression_count")).alias("engagement_rate"),
        F.col("tweet.in_reply_to_user_id").isNotNull().alias("is_reply"),
        F.coalesce(
            F.get("tweet.referenced_tweets", F.lit(0))["type"] == "retweeted", F.lit(False)
        ).alias("is_retweet"),
    )
    reasons = {"id": F.col("id").isNull(), "text": F.col("text").isNull(), "date": F.col("created_at").isNull()}
    return keep(found, reasons, watch, "twitter")
