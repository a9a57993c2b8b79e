"""Readers of landed raw files.  Every reader has a fixed schema; broken lines become null rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeflow import schemas
from themeflow.functions.dates import parse_iso
from themeflow.operators.staging import stage


def read_tweet_pages(spark: SparkSession, path: str) -> DataFrame:
    """Search result pages, one JSON object per line with its ``query`` and ``page``."""
    return spark.read.schema(schemas.TWEET_PAGE).json(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUBMISSION).json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLE).json(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries, one JSON object per line."""
    return spark.read.schema(schemas.EPISODE).json(path)


def _read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """One row per element ``row_tag`` with its file and its ``position`` in the feed's files.

    Rows of one file come in order within a split; splits are ordered by their start, files of one
    feed by their path.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select(*schema.fieldNames(), place.alias("position"))


def _with_show(entries: DataFrame, spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """``entries`` with ``show_name``, the title of the ``row_tag`` element of their file.

    The same files are read by another row tag for the headers: one short row per file, staged, so
    that Spark knows how little is joined.  A file of several headers takes the first by name.
    """
    headers = _read_xml(spark, path, row_tag, schemas.FEED_HEADER)
    titles = headers.groupBy(F.col("position.file").alias("_file")).agg(F.min("title").alias("show_name"))
    return entries.join(stage(titles, "feed-titles"), F.col("position.file") == F.col("_file"), "left").drop("_file")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """RSS files landed under ``feed_url=<url>/``, one row per item; the channel's title is the show.

    Items are split off one by one, so their texts are never held in one row.  A feed may come as
    several files, in the order of their paths.
    """
    items = _with_show(_read_xml(spark, path, "item", schemas.FEED_ITEM), spark, path, "channel")

    def links(tags: str, rel: str) -> Column:
        return F.transform(
            F.coalesce(F.col(tags), F.array().cast("array<struct<_url: string, _type: string>>")),
            lambda tag: F.struct(
                tag["_url"].alias("href"), F.lit(rel).alias("rel"), tag["_type"].alias("type")
            ),
        )

    page = F.array(
        F.struct(F.col("link").alias("href"), F.lit("alternate").alias("rel"), F.lit("text/html").alias("type"))
    )
    content = F.filter(
        F.array(F.struct(F.col("`content:encoded`").alias("value"))), lambda part: part["value"].isNotNull()
    )
    return items.select(
        "feed_url",
        "show_name",
        "position",
        F.col("guid").alias("id"),
        "guid",
        "link",
        "title",
        F.col("pubDate").alias("published"),
        parse_iso("`dc:date`").alias("published_parsed"),
        F.lit(None).cast("timestamp").alias("updated_parsed"),
        content.alias("content"),
        F.coalesce("`itunes:summary`", "description").alias("summary"),
        "description",
        F.concat(page, links("enclosure", "enclosure"), links("`podcast:transcript`", "transcript")).alias("links"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Atom files landed under ``feed_url=<url>/``, one row per entry; the feed's title is the show."""
    entries = _with_show(_read_xml(spark, path, "entry", schemas.ATOM_ENTRY), spark, path, "feed")
    none = F.array().cast("array<struct<href: string, rel: string, type: string>>")
    links = F.transform(
        "link",
        lambda x: F.struct(
            x["_href"].alias("href"), F.coalesce(x["_rel"], F.lit("alternate")).alias("rel"), x["_type"].alias("type")
        ),
    )
    links = F.coalesce(links, none)
    page = F.get(F.filter(links, lambda x: x["rel"] == "alternate"), F.lit(0))["href"]
    content = F.filter(F.array(F.struct(F.col("content").alias("value"))), lambda x: x["value"].isNotNull())
    return entries.select(
        "feed_url",
        "show_name",
        "position",
        "id",
        F.lit(None).cast("string").alias("guid"),
        page.alias("link"),
        "title",
        F.lit(None).cast("string").alias("published"),
        parse_iso("published").alias("published_parsed"),
        parse_iso("updated").alias("updated_parsed"),
        content.alias("content"),
        "summary",
        F.lit(None).cast("string").alias("description"),
        links.alias("links"),
    )
