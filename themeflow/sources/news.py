"""News articles from landed JSON lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import NEWS_TEXT_CHARS, POST_DIGEST_CHARS
from themeflow.functions.core import digest_id, instant, or_else
from themeflow.functions.dates import parse_iso
from themeflow.functions.text import cashtags, hashtags, join_paragraphs
from themeflow.operators.observed import Watch, keep
from themeflow.sources.forum import tag_set


def normalise(articles: DataFrame, collected_at: Column | datetime, watch: Watch | None = None) -> DataFrame:
    """One row per article with all post and news columns, plus ``query`` and ``position``.

    Articles without url or a readable date are dropped; a watch counts them as ``news``.  Tags come
    from the cut text.
    """
    title = F.coalesce("title", F.lit(""))
    text = F.substring(join_paragraphs(F.array(title, "description", "content")), 1, NEWS_TEXT_CHARS)
    source_name = or_else(F.col("source.name"), "unknown")
    dated = articles.withColumn("created_at", parse_iso("publishedAt"))
    reasons = {"url": F.col("url") == "", "date": F.col("created_at").isNull()}
    readable = keep(dated, reasons, watch, "news").withColumn("_text", text)
    return readable.select(
        "query",
        "position",
        digest_id("news_", F.col("url"), POST_DIGEST_CHARS).alias("id"),
        F.lit("news").alias("platform"),
        or_else(F.col("source.id"), source_name).alias("author_id"),
        source_name.alias("author_username"),
        or_else(F.col("_text"), title).alias("text"),
        "created_at",
        F.lit(0).cast("long").alias("likes"),
        F.lit(0).cast("long").alias("replies"),
        F.lit(0).cast("long").alias("reposts"),
        F.lit(None).cast("string").alias("language"),
        tag_set(cashtags("_text")).alias("cashtags"),
        tag_set(hashtags("_text")).alias("hashtags"),
        F.array("url").alias("urls"),
        instant(collected_at).alias("collected_at"),
        F.lit(False).alias("processed"),
        source_name.alias("source_name"),
        F.col("source.id").alias("source_id"),
        or_else(title, F.col("url")).alias("title"),
        "description",
        F.col("url").alias("article_url"),
        F.col("urlToImage").alias("image_url"),
    )
