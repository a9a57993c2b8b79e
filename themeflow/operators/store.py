"""The post store: first write wins, look-ups, flags and counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import FALLBACK_TITLE_CHARS, PLATFORMS
from themeflow.functions.core import instant
from themeflow.operators.id_index import IdIndex
from themeflow.operators.ranking import first_per_group
from themeflow.operators.staging import stage
from themeflow.schemas import REQUIRED_POST_COLUMNS


def is_complete() -> Column:
    """True when every required column is present; other rows can not be stored."""
    present = F.lit(True)
    for name in REQUIRED_POST_COLUMNS:
        present = present & F.col(name).isNotNull()
    return present


def first_of_batch(incoming: DataFrame, arrival: str) -> DataFrame:
    """The earliest arrival of each id.

    Each task keeps one row per id before the shuffle, so copies of one post never meet in
    numbers, however many there are.
    """
    return first_per_group(incoming, ["id"], [arrival], 1, "id")


#: The ids of a batch are broadcast to the store up to this many bytes.
BROADCAST_BYTES = 64 << 20
#: What a word of ``of_arrivals`` takes when it is broadcast.
WORD_BYTES = 64


def known_ids(
    incoming: DataFrame, stored: DataFrame | IdIndex, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Ids of ``incoming`` that are stored already: as many as the batch has at most.

    The batch is read once, for its distinct ids.  An index reads the buckets that may hold one of
    them.  Of a plain table, the ids of a small batch go to the store, which stays where it is; a batch of more than
    ``broadcast_bytes`` of ids meets the stored ids in a shuffle.
    """
    ids = stage(incoming.select("id").filter(F.col("id").isNotNull()).distinct(), "batch-ids", release=True)
    if isinstance(stored, IdIndex):
        return stored.known(ids)
    size = ids.agg(F.coalesce(F.sum(F.octet_length("id") + 32), F.lit(0))).first()[0]
    return stored.select("id").join(F.broadcast(ids) if size <= broadcast_bytes else ids, "id", "left_semi")


def new_posts(
    incoming: DataFrame, stored: DataFrame | IdIndex | None, arrival: str, broadcast_bytes: int = BROADCAST_BYTES,
    known: DataFrame | None = None,
) -> DataFrame:
    """Rows a first-write-wins store would insert, ids being unique across platforms.

    ``known`` are the ids that ``known_ids`` found, where the caller has them already.
    """
    firsts = first_of_batch(incoming.filter(is_complete()), arrival)
    if stored is None:
        return firsts
    known = known_ids(incoming, stored, broadcast_bytes) if known is None else known
    return firsts.join(known, "id", "left_anti")


def of_arrivals(
    batch: DataFrame, arrivals: DataFrame, arrival: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows of ``batch`` whose whole number ``arrival`` is in ``arrivals``.

    Numbers are packed as bits, 64 of them to a word.  Words of up to ``broadcast_bytes`` go to the rows, which stay
    where they are; beyond it rows and numbers meet in a shuffle.
    """
    number = F.col(arrival)
    bit = (number % 64).cast("int")
    words = stage(
        arrivals.groupBy(F.shiftright(arrival, 6).alias("_word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")
        ),
        "arrival-words", release=True,
    )
    if words.count() * WORD_BYTES > broadcast_bytes:
        return batch.join(arrivals, arrival, "left_semi")
    found = batch.join(F.broadcast(words), F.shiftright(arrival, 6) == F.col("_word"))
    return found.filter(F.call_function("getbit", "_bits", bit) == 1).select(*batch.columns)


def load_report(
    incoming: DataFrame, stored: DataFrame | IdIndex | None, arrival: str, source: str = "platform",
    configured: Sequence[str] = (), known: DataFrame | None = None,
    started_at: Column | datetime | None = None, completed_at: Column | datetime | None = None,
) -> DataFrame:
    """``source, posts_stored, duplicates_skipped, rejected`` of one load, and how it went.

    ``errors`` names each required column that rows lacked, with the number of rows; ``success`` is
    false where every row was rejected; ``started_at`` and ``completed_at`` are the run's times as the
    caller gives them.  A configured source that delivered nothing has a row of zeros.
    Duplicates are what is neither stored nor rejected, so only counts are needed, never a
    ranking of all copies of an id.
    """
    missing = {name: F.count_if(F.col(name).isNull()) for name in REQUIRED_POST_COLUMNS}
    messages = [
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" rows without {name}")))
        for name, n in missing.items()
    ]
    arrived = incoming.groupBy(source).agg(
        F.count("*").alias("arrived"),
        F.count_if(~is_complete()).alias("rejected"),
        F.array_compact(F.array(*messages)).alias("errors"),
    )
    if configured:
        names = incoming.sparkSession.createDataFrame([(x,) for x in configured], f"`{source}` string")
        arrived = arrived.join(F.broadcast(names), source, "right").withColumns(
            {
                "arrived": F.coalesce("arrived", F.lit(0).cast("long")),
                "rejected": F.coalesce("rejected", F.lit(0).cast("long")),
                "errors": F.coalesce("errors", F.array().cast("array<string>")),
            }
        )
    narrow = incoming.select(*{*REQUIRED_POST_COLUMNS, arrival, source})
    inserted = new_posts(narrow, stored, arrival, known=known).groupBy(source).agg(F.count("*").alias("n"))
    stored_count = F.coalesce("n", F.lit(0))
    return arrived.join(inserted, source, "left").select(
        F.col(source).alias("source"),
        stored_count.alias("posts_stored"),
        (F.col("arrived") - F.col("rejected") - stored_count).alias("duplicates_skipped"),
        "rejected",
        "errors",
        ((F.col("rejected") == 0) | (F.col("rejected") < F.col("arrived"))).alias("success"),
        instant(started_at).alias("started_at"),
        instant(completed_at).alias("completed_at"),
    )


def post_by_id(posts: DataFrame, post_id: str) -> DataFrame:
    """The post of that id, or no row; posts of unknown platforms are not returned."""
    return posts.filter((F.col("id") == post_id) & F.col("platform").isin(*PLATFORMS))


def tweet_by_id(posts: DataFrame, post_id: str) -> DataFrame:
    """The tweet of that id; no row for a post of another platform."""
    return post_by_id(posts, post_id).filter(F.col("platform") == "twitter")


def unprocessed(posts: DataFrame, limit: int = 100, platform: str | None = None) -> DataFrame:
    """Newest unprocessed posts.  Unknown platforms use up the limit but are not returned."""
    waiting = posts.filter(~F.col("processed"))
    if platform is not None:
        waiting = waiting.filter(F.col("platform") == platform)
    newest = waiting.orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.filter(F.col("platform").isin(*PLATFORMS))


def unprocessed_newest(
    posts: DataFrame, days: Sequence[date], limit: int = 100, platform: str | None = None,
    marks: DataFrame | None = None, day_col: str = "created_date", first_days: int = 1,
) -> DataFrame:
    """As ``unprocessed``, of a store in folders by day: days are read from the newest until the limit is filled.

    ``days`` are those of the store, newest first (``tables.stored_days``).  Twice as many are read in
    each round, and none older than needed; ``marks`` is a log of processed ids to leave out.
    """
    waiting = posts.filter(~F.col("processed"))
    if platform is not None:
        waiting = waiting.filter(F.col("platform") == platform)
    if marks is not None:
        waiting = without_processed(waiting, marks)
    at, found, chosen, step = 0, 0, [], first_days
    while at < len(days) and found < limit:
        some = list(days[at : at + step])
        # As many rows as are missing settle it.
        found += waiting.filter(F.col(day_col).isin(some)).select("id").limit(limit - found).count()
        chosen, at, step = chosen + some, at + step, 2 * step
    newest = waiting.filter(F.col(day_col).isin(chosen)).orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.filter(F.col("platform").isin(*PLATFORMS)).drop(day_col)


def mark_processed(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts with ``processed`` set for the given ids (column ``id``)."""
    marks = ids.select("id").distinct().withColumn("_marked", F.lit(True))
    return (
        posts.join(marks, "id", "left")
        .withColumn("processed", F.col("processed") | F.coalesce("_marked", F.lit(False)))
        .drop("_marked")
    )


def count_marked(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """How many stored posts the ids match, already processed ones included."""
    return posts.select("id").join(ids.select("id"), "id", "left_semi").agg(F.count("*").alias("marked"))


def without_processed(posts: DataFrame, processed_ids: DataFrame) -> DataFrame:
    """Posts not in an append-only log of processed ids; no snapshot is rewritten."""
    return posts.join(processed_ids.select("id"), "id", "left_anti")


def stats(posts: DataFrame) -> DataFrame:
    """All counts from one pass."""
    per_platform = {
        name: F.count_if(F.col("platform") == name).alias(name) for name in PLATFORMS
    }
    return posts.agg(
        F.count("*").alias("total_posts"),
        F.count_if(F.col("platform") == "twitter").alias("total_tweets"),
        F.count_if(~F.col("processed")).alias("unprocessed"),
        F.count_if("processed").alias("processed"),
        *per_platform.values(),
    )


def with_extensions(posts: DataFrame, extensions: dict[str, DataFrame]) -> DataFrame:
    """Posts with the columns of their platform, defaults where the extension row is missing.

    ``extensions`` maps a platform to its table (column ``post_id``).  Columns that two platforms
    share (``title``) come out once.  All joins are on the post id: posts move once.
    """
    wide = posts.withColumn("_first_url", F.coalesce(F.get("urls", F.lit(0)), F.lit("")))
    for platform, extension in extensions.items():
        found = extension.withColumnsRenamed(
            {name: f"{platform}_{name}" for name in extension.columns if name != "post_id"}
        ).withColumns({f"{platform}_found": F.lit(True), f"{platform}_of": F.lit(platform)})
        on = (F.col("id") == found["post_id"]) & (F.col("platform") == found[f"{platform}_of"])
        wide = wide.join(found, on, "left").drop("post_id", f"{platform}_of")

    def ext(platform: str, name: str, default: Column | None = None) -> Column:
        value = F.col(f"{platform}_{name}")
        if default is None:
            return value
        missing = F.col("platform") == platform
        return F.when(F.col(f"{platform}_found"), value).when(missing, default)

    zero, no, yes = F.lit(0).cast("long"), F.lit(False), F.lit(True)
    start = F.substring("text", 1, FALLBACK_TITLE_CHARS)
    columns: list[Column] = []
    if "twitter" in extensions:
        columns += [
            ext("twitter", "impressions", zero).alias("impressions"),
            ext("twitter", "quote_tweets", zero).alias("quote_tweets"),
            ext("twitter", "bookmarks", zero).alias("bookmarks"),
            ext("twitter", "engagement_rate").alias("engagement_rate"),
            ext("twitter", "is_reply", no).alias("is_reply"),
            ext("twitter", "is_retweet", no).alias("is_retweet"),
        ]
    if "reddit" in extensions:
        columns += [
            ext("reddit", "subreddit", F.lit("")).alias("subreddit"),
            ext("reddit", "upvotes", zero).alias("upvotes"),
            ext("reddit", "downvotes", zero).alias("downvotes"),
            ext("reddit", "awards", zero).alias("awards"),
            ext("reddit", "is_self", yes).alias("is_self"),
            ext("reddit", "permalink").alias("permalink"),
        ]
    if "news" in extensions:
        columns += [
            ext("news", "source_name", F.lit("unknown")).alias("source_name"),
            ext("news", "source_id").alias("source_id"),
            ext("news", "description").alias("description"),
            ext("news", "article_url", F.col("_first_url")).alias("article_url"),
            ext("news", "image_url").alias("image_url"),
        ]
    if "podcast" in extensions:
        columns += [
            ext("podcast", "show_name", F.lit("unknown")).alias("show_name"),
            ext("podcast", "episode_title", start).alias("episode_title"),
            ext("podcast", "episode_url").alias("episode_url"),
            ext("podcast", "audio_url").alias("audio_url"),
            ext("podcast", "transcript_source").alias("transcript_source"),
        ]
    titles = []
    if "reddit" in extensions:
        titles.append(ext("reddit", "title"))
    if "news" in extensions:
        titles.append(ext("news", "title", start))
    if titles:
        columns.append(F.coalesce(*titles).alias("title"))
    return wide.select(*posts.columns, *columns)
