"""Forum submissions from landed JSON lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import FORUM_TEXT_CHARS
from themeflow.functions.core import instant, or_else
from themeflow.functions.dates import parse_epoch_seconds
from themeflow.functions.text import cashtags, hashtags, urls


def tag_set(tags: Column) -> Column:
    """Distinct tags, sorted because a set has no order of its own."""
    return F.sort_array(F.array_distinct(tags))


def with_created_at(submissions: DataFrame) -> DataFrame:
    """Submissions with a ``created_at`` time, as the search operators expect them."""
    return submissions.withColumn("created_at", parse_epoch_seconds("created_utc"))


def normalise(submissions: DataFrame, collected_at: Column | datetime) -> DataFrame:
    """One row per submission with all post and forum columns.

    Tags come from the whole text, the stored text is cut.  Columns of the input that the search
    added (such as ``listing_rank``) are not carried over.
    """
    body = F.nullif(F.col("selftext"), F.lit(""))
    full = submissions.withColumn("_text", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), body))
    none = F.array().cast("array<string>")
    is_self = F.coalesce("is_self", F.lit(True))
    outside = F.when(~is_self & (F.col("url") != ""), F.array("url")).otherwise(none)
    links = F.concat(F.coalesce(outside, none), F.coalesce(urls("selftext"), none))
    author = or_else(F.col("author"), "deleted")
    return full.select(
        F.concat(F.lit("reddit_"), "id").alias("id"),
        F.lit("reddit").alias("platform"),
        author.alias("author_id"),
        author.alias("author_username"),
        F.substring("_text", 1, FORUM_TEXT_CHARS).alias("text"),
        parse_epoch_seconds("created_utc").alias("created_at"),
        F.col("score").alias("likes"),
        F.col("num_comments").alias("replies"),
        F.lit(0).cast("long").alias("reposts"),
        F.lit(None).cast("string").alias("language"),
        tag_set(cashtags("_text")).alias("cashtags"),
        tag_set(hashtags("_text")).alias("hashtags"),
        tag_set(links).alias("urls"),
        instant(collected_at).alias("collected_at"),
        F.lit(False).alias("processed"),
        "subreddit",
        "title",
        F.col("score").alias("upvotes"),
        F.coalesce("downs", F.lit(0)).alias("downvotes"),
        F.coalesce("total_awards_received", F.lit(0)).alias("awards"),
        is_self.alias("is_self"),
        F.concat(F.lit("https://reddit.com"), "permalink").alias("permalink"),
    )
