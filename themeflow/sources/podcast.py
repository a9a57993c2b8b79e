"""Podcast episodes from landed feed entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import PODCAST_TEXT_CHARS, POST_DIGEST_CHARS
from themeflow.functions.core import digest_id, instant, or_else, strip, with_computed
from themeflow.functions.dates import parse_rfc2822
from themeflow.functions.text import cashtags, hashtags, markup_to_text
from themeflow.operators.observed import Watch, keep
from themeflow.sources.forum import tag_set

# --- fixed values: what stands for an absent title or transcript link ---------------------
UNTITLED = "Untitled Episode"
DEFAULT_TRANSCRIPT_SOURCE = "rss:description"


def transcript_text() -> Column:
    """Content parts, summary and description as plain text, repeats dropped."""
    none = F.array().cast("array<string>")
    chunks = F.concat(
        F.coalesce(F.col("content.value"), none), F.array("summary", "description")
    )
    present = F.filter(chunks, lambda chunk: chunk.isNotNull() & (chunk != ""))
    # A summary is often the description itself; equal chunks are cleaned once.
    plain = F.filter(F.transform(F.array_distinct(present), markup_to_text), lambda text: text != "")
    return F.array_join(F.array_distinct(plain), "\n\n")


def _first_link(wanted) -> Column:
    def matches(link: Column) -> Column:
        rel = F.lower(F.coalesce(link["rel"], F.lit("")))
        kind = F.lower(F.coalesce(link["type"], F.lit("")))
        return (F.coalesce(link["href"], F.lit("")) != "") & wanted(rel, kind)

    return F.get(F.filter("links", matches), F.lit(0))["href"]


def audio_url() -> Column:
    return _first_link(lambda rel, kind: (rel == "enclosure") | kind.startswith("audio/"))


def transcript_source() -> Column:
    link = _first_link(lambda rel, kind: rel.contains("transcript") | kind.contains("transcript"))
    return F.coalesce(link, F.lit(DEFAULT_TRANSCRIPT_SOURCE))


def published_at(as_of: Column | datetime) -> Column:
    """Written date, then the parsed ones of the feed, then ``as_of``."""
    return F.coalesce(parse_rfc2822("published"), "published_parsed", "updated_parsed", instant(as_of))


def normalise(entries: DataFrame, collected_at: Column | datetime, watch: Watch | None = None) -> DataFrame:
    """One row per episode with all post and podcast columns, plus ``feed_url``.

    Entries without any identifier or text are dropped; a watch counts them as ``podcast``.  Tags come from the whole transcript,
    the stored text is cut.
    """
    guid = or_else(F.col("id"), or_else(F.col("guid"), F.nullif(F.col("link"), F.lit(""))))
    show = or_else(F.col("show_name"), "unknown")
    identified = with_computed(entries.withColumn("_guid", guid), "_text", transcript_text())
    reasons = {"identifier": F.col("_guid").isNull(), "text": F.col("_text") == ""}
    parsed = keep(identified, reasons, watch, "podcast").withColumn("_audio", audio_url())
    seed = F.concat_ws(":", "feed_url", "_guid")
    return parsed.select(
        "feed_url",
        digest_id("podcast_", seed, POST_DIGEST_CHARS).alias("id"),
        F.lit("podcast").alias("platform"),
        show.alias("author_id"),
        show.alias("author_username"),
        F.substring("_text", 1, PODCAST_TEXT_CHARS).alias("text"),
        published_at(collected_at).alias("created_at"),
        F.lit(0).cast("long").alias("likes"),
        F.lit(0).cast("long").alias("replies"),
        F.lit(0).cast("long").alias("reposts"),
        F.lit(None).cast("string").alias("language"),
        tag_set(cashtags("_text")).alias("cashtags"),
        tag_set(hashtags("_text")).alias("hashtags"),
        F.filter(F.array("link", "_audio"), lambda url: url.isNotNull() & (url != "")).alias("urls"),
        instant(collected_at).alias("collected_at"),
        F.lit(False).alias("processed"),
        show.alias("show_name"),
        strip(or_else(F.col("title"), UNTITLED)).alias("episode_title"),
        F.col("link").alias("episode_url"),
        F.col("_audio").alias("audio_url"),
        transcript_source().alias("transcript_source"),
    )
