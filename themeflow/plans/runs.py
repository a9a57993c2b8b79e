"""Whole runs: ingest, analyse, track.

A run composes operators and decides what is staged.  Settings are explicit: a zero is a zero,
only ``None`` means "take the configured value".
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import MAX_KEYWORDS, MIN_CLUSTER_SIZE
from themeflow.functions.core import hours_before
from themeflow.operators import cluster, lifecycle, scoring, search, sentiment, store
from themeflow.operators.id_index import IdIndex
from themeflow.operators.observed import Watch
from themeflow.operators.sentiment import DEFAULT_LEXICON, Lexicon, LexiconTable
from themeflow.operators.staging import stage, stage_alone
from themeflow.schemas import REQUIRED_POST_COLUMNS
from themeflow.sources import forum, news, podcast, tables, tweets


@dataclass(frozen=True)
class IngestConfig:
    """What to ingest.  The numbers are the defaults of the surveyed pipeline."""

    twitter_enabled: bool = True
    twitter_queries: Sequence[str] = ()
    twitter_max_results: int = 100
    twitter_min_likes: int = 10
    reddit_enabled: bool = True
    reddit_subreddits: Sequence[str] = ()
    reddit_keywords: Sequence[str] = ()
    reddit_max_results: int = 50
    reddit_min_upvotes: int = 5
    reddit_sort: str = "hot"
    news_enabled: bool = True
    news_queries: Sequence[str] = ()
    news_max_results: int = 50
    news_language: str = "en"
    news_domains: Sequence[str] = ()
    podcast_enabled: bool = True
    podcast_feeds: Sequence[str] = ()
    podcast_max_episodes: int = 20
    podcast_keywords: Sequence[str] = ()
    hours_back: int = 24

    def enabled_sources(self) -> list[str]:
        """Sources that are switched on and have something to search for."""
        wanted = {
            "twitter": self.twitter_enabled and self.twitter_queries,
            "reddit": self.reddit_enabled and self.reddit_subreddits,
            "news": self.news_enabled and self.news_queries,
            "podcast": self.podcast_enabled and self.podcast_feeds,
        }
        return [name for name, on in wanted.items() if on]


def ingest_tweets(
    pages: DataFrame, config: IngestConfig, as_of: Column | datetime, watch: Watch | None = None
) -> DataFrame:
    found = tweets.normalise(pages.filter(F.col("query").isin(*config.twitter_queries)), as_of, watch)
    return search.capped_search(
        found, config.twitter_max_results, "arrival",
        thresholds={"likes": config.twitter_min_likes} if config.twitter_min_likes > 0 else None,
        start=hours_before(as_of, config.hours_back),
    ).drop("query", "arrival")


def ingest_forum(
    submissions: DataFrame, config: IngestConfig, as_of: Column | datetime, watch: Watch | None = None
) -> DataFrame:
    dated = forum.with_created_at(submissions)
    if watch is not None:
        # Without an id a row is rejected by the store; without a date it is outside any window.
        wanted = F.col("subreddit").isin(*config.reddit_subreddits)
        missing = {"id": wanted & F.col("id").isNull(), "date": wanted & F.col("id").isNotNull() & F.col("created_at").isNull()}
        dated = watch.seen(dated, "reddit", missing)
    found = search.search_subreddits(
        dated, config.reddit_subreddits, config.reddit_keywords,
        config.reddit_sort, max_results=config.reddit_max_results,
        min_upvotes=config.reddit_min_upvotes, hours_back=config.hours_back, as_of=as_of, ranked=False,
    )
    return forum.normalise(found, as_of)


def ingest_news(
    articles: DataFrame, config: IngestConfig, as_of: Column | datetime, watch: Watch | None = None
) -> DataFrame:
    wanted = articles.filter(F.col("query").isin(*config.news_queries)).filter(
        F.col("language").isNull() | (F.col("language") == config.news_language)
    )
    return search.news_window(
        news.normalise(wanted, as_of, watch), as_of, config.hours_back, config.news_max_results,
        domains=config.news_domains,
    ).drop("query", "position")


def ingest_podcasts(
    entries: DataFrame, config: IngestConfig, as_of: Column | datetime, watch: Watch | None = None
) -> DataFrame:
    wanted = entries.filter(F.col("feed_url").isin(*config.podcast_feeds))
    episodes = podcast.normalise(
        search.first_entries(wanted, config.podcast_max_episodes), as_of, watch
    )
    return search.episode_keywords(episodes, config.podcast_keywords).drop("feed_url")


INGESTERS: dict[str, Callable[[DataFrame, IngestConfig, Column | datetime, Watch | None], DataFrame]] = {
    "twitter": ingest_tweets,
    "reddit": ingest_forum,
    "news": ingest_news,
    "podcast": ingest_podcasts,
}


#: A landed line of which all these are null was no readable payload.
PAYLOAD = {
    "twitter": ("query", "data"),
    "reddit": ("id", "created_utc", "subreddit"),
    "news": ("query", "url", "publishedAt"),
    "podcast": ("feed_url", "id", "link", "title"),
}


def _watched(rows: DataFrame, name: str, watch: Watch | None) -> DataFrame:
    if watch is None:
        return rows
    unreadable = F.lit(True)
    for column in PAYLOAD[name]:
        unreadable = unreadable & F.col(column).isNull()
    return watch.seen(rows, f"{name}-landed", {"unreadable": unreadable})


def ingest(
    landed: dict[str, DataFrame], config: IngestConfig, as_of: Column | datetime, watch: Watch | None = None
) -> DataFrame | None:
    """Posts of all enabled sources in one job graph; ``None`` when no source is configured.

    A watch counts the landed lines of each source, those without a readable payload, and what its
    normaliser drops.
    """
    parts = [
        INGESTERS[name](_watched(landed[name], name, watch), config, as_of, watch)
        for name in config.enabled_sources()
        if name in landed
    ]
    return tables.unify(parts) if parts else None


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def load(
    incoming: DataFrame, stored: DataFrame | IdIndex | None, arrival: str, clock: Callable[[], datetime] = utc_now
) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the store and the load report.

    Both read the batch and the ids that are known of it, so both are staged: texts are normalised
    once and the store is asked once.  The report's times are those of the run by ``clock``.
    """
    started = clock()
    batch = stage(incoming, "incoming")
    known = None if stored is None else stage(store.known_ids(batch, stored), "known-ids")
    fresh = store.new_posts(batch, stored, arrival, known=known)
    report = store.load_report(batch, stored, arrival, known=known, started_at=started, completed_at=clock())
    return fresh, report


#: Of a post's arrival number, those below the number of its source: tasks up to 2^26, 2^33 rows in each.
ARRIVAL_BITS = 59


def run_ingest(
    landed: dict[str, DataFrame], config: IngestConfig, as_of: Column | datetime,
    stored: DataFrame | IdIndex | None, write: Callable[[DataFrame], None],
    clock: Callable[[], datetime] = utc_now,
) -> DataFrame:
    """Ingest, store and report: one row for each enabled source of ``config``.

    ``write`` appends the new posts it is given to the store.  Nothing is scanned for the report: its
    counts are collected by the jobs that stage the batch and find the new posts.  Columns are those of ``store.load_report`` and, before the batch, ``landed`` lines,
    ``unreadable`` ones among them and records ``dropped`` by the normaliser; these three may be too
    high where a stage had to be run again.
    """
    spark = next(iter(landed.values())).sparkSession
    started, watch = clock(), Watch()
    sources = [name for name in config.enabled_sources() if name in landed]
    counted = {"rejected": ~store.is_complete()} | {c: F.col(c).isNull() for c in REQUIRED_POST_COLUMNS}

    def arrived(at: int, name: str) -> DataFrame:
        # Sources arrive one after the other; a task's number and a row's in it take the lower bits.
        number = F.monotonically_increasing_id() + F.lit(at << ARRIVAL_BITS).cast("long")
        posts = INGESTERS[name](_watched(landed[name], name, watch), config, as_of, watch)
        return watch.seen(posts.withColumn("arrival", number), f"{name}-batch", counted)

    if sources:
        # Each source is staged by itself, so that the disk holds what one of them shuffles and stages for its caps.
        batch = tables.unify(
            stage_alone(spark, f"incoming-{name}", partial(arrived, at, name), "zstd") for at, name in enumerate(sources)
        )
        # Ids are ranked and counted without the texts; the rows that win are written.
        firsts = store.new_posts(batch.select(*REQUIRED_POST_COLUMNS, "arrival"), stored, "arrival")
        of_source = {name: F.col("platform") == name for name in sources}
        firsts = watch.seen(firsts.select("arrival", "platform"), "stored", of_source)
        firsts = stage(firsts, "first-posts", release=True)
        write(store.of_arrivals(batch, firsts.select("arrival"), "arrival").drop("arrival"))
    completed = clock()
    rows = []
    for name in sources:
        before, dropped = watch.counts(f"{name}-landed"), watch.counts(name)
        seen = watch.counts(f"{name}-batch")
        kept = watch.counts("stored")[name]
        errors = [f"{before['unreadable']} unreadable lines"] if before["unreadable"] else []
        errors += [f"{n} records without {why}" for why, n in dropped.items() if why != "rows" and n]
        errors += [f"{seen[c]} rows without {c}" for c in REQUIRED_POST_COLUMNS if seen[c]]
        lost = sum(n for why, n in dropped.items() if why != "rows")
        rows.append(
            (name, kept, seen["rows"] - seen["rejected"] - kept, seen["rejected"], errors,
             seen["rejected"] == 0 or seen["rejected"] < seen["rows"], started, completed,
             before["rows"], before["unreadable"], lost)
        )
    return spark.createDataFrame(rows, RUN_REPORT)


RUN_REPORT = (
    "source string, posts_stored long, duplicates_skipped long, rejected long, errors array<string>, success boolean, "
    "started_at timestamp, completed_at timestamp, landed long, unreadable long, dropped long"
)


@dataclass(frozen=True)
class Analysis:
    clusters: DataFrame
    assigned: DataFrame

    @property
    def narratives(self) -> DataFrame:
        return cluster.as_narratives(self.clusters)

    @property
    def membership(self) -> DataFrame:
        return cluster.membership(self.assigned, self.clusters)


def analyse(
    posts: DataFrame, as_of: Column | datetime, lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON,
    min_size: int = MIN_CLUSTER_SIZE, max_keywords: int = MAX_KEYWORDS,
    hours: int = scoring.WINDOW_HOURS, staged: bool = True,
) -> Analysis:
    """Cluster posts and fill all scores.

    A post belongs to the theme of its own group key, so all scores are aggregates by key and no
    join of members with posts is needed.  ``staged`` writes the narrow assignment once; without
    it every aggregate reads the texts again.
    """
    scoring.check_window(hours)
    assigned = cluster.assign(posts, lexicon)
    if staged:
        assigned = stage(assigned, "assigned")
    recent = F.col("created_at") > hours_before(as_of, hours)
    found = cluster.cluster(posts, assigned, min_size, max_keywords, as_of, recent)
    all_posts = assigned.agg(F.count("*")).scalar()
    score = sentiment.weighted_score(F.col("weighted"), F.col("weights"))
    velocity = scoring.velocity_score(F.col("recent_posts"), F.col("recent_engagement"), hours)
    saturation = scoring.saturation_score(F.col("n_posts"), F.col("authors"), all_posts)
    scored = found.withColumns(
        {"sentiment_score": score, "velocity_score": velocity, "saturation_score": saturation}
    ).withColumn(
        "overall_score",
        sentiment.overall_score(
            F.col("sentiment_score"), F.col("velocity_score"), F.col("saturation_score")
        ),
    )
    return Analysis(scored, assigned)


def track(
    posts: DataFrame, state: DataFrame, as_of: Column | datetime,
    min_size: int = MIN_CLUSTER_SIZE, stale_hours: int = lifecycle.STALE_HOURS,
) -> tuple[lifecycle.Reconciled, DataFrame, DataFrame]:
    """Cluster unprocessed posts and merge them into the state.

    Returns the merged state, the membership of the batch and the ids to mark as processed:
    all posts given, clustered or not.
    """
    assigned = stage(cluster.assign(posts), "assigned")
    clusters = stage(cluster.cluster(posts, assigned, min_size), "clusters")
    merged = lifecycle.reconcile(state, cluster.as_narratives(clusters), as_of, stale_hours)
    return merged, cluster.membership(assigned, clusters), assigned.select("id")
