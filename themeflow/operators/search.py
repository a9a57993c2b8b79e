"""Filters and per-source caps of the ingest searches.

A cap is a ranking per query, subreddit or feed with an upper bound, which Spark applies in each
task before the shuffle: a source with a third of all rows sends at most the cap per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.functions.core import hours_before, instant
from themeflow.functions.text import contains_any
from themeflow.operators.ranking import DIRECT_LIMIT, first_per_group

# --- fixed values: names of the engagement thresholds and of the listing periods ----------
THRESHOLD_COLUMNS = {"likes": "likes", "retweets": "reposts", "replies": "replies"}
PERIOD_HOURS = {"hour": 1, "day": 24, "week": 7 * 24, "month": 30 * 24, "year": 365 * 24, "all": None}


def engagement_filter(posts: DataFrame, thresholds: dict[str, int] | None) -> DataFrame:
    """Keep posts that reach every threshold given; unknown names are ignored."""
    for name, least in (thresholds or {}).items():
        if name in THRESHOLD_COLUMNS:
            posts = posts.filter(F.col(THRESHOLD_COLUMNS[name]) >= least)
    return posts


def capped_search(
    posts: DataFrame, max_results: int, arrival: str, query: str = "query",
    thresholds: dict[str, int] | None = None,
    start: Column | datetime | None = None, end: Column | datetime | None = None,
) -> DataFrame:
    """First ``max_results`` posts per query that pass the filters."""
    if start is not None:
        posts = posts.filter(F.col("created_at") >= instant(start))
    if end is not None:
        posts = posts.filter(F.col("created_at") <= instant(end))
    return first_per_group(engagement_filter(posts, thresholds), [query], [arrival], max_results, "id")


def _listing_order(sort: str) -> list[Column]:
    if sort == "new":
        return [F.desc("created_at"), F.col("id")]
    if sort == "top":
        return [F.desc("score"), F.col("id")]
    if sort in ("hot", "rising"):
        return [F.col("rank"), F.col("id")]
    raise ValueError(f"invalid sort {sort!r}: use hot, new, top or rising")


def listing(
    submissions: DataFrame, sort: str = "hot", as_of: Column | datetime | None = None,
    time_filter: str | None = None, limit: int = 100, rank: str | None = "listing_rank",
) -> DataFrame:
    """First ``limit`` submissions per subreddit with their ``listing_rank``, unless it isn't asked for.

    ``hot`` and ``rising`` are rankings of the forum itself and need its landed ``rank``.
    """
    order = _listing_order(sort)
    if sort == "top":
        hours = PERIOD_HOURS[time_filter or "day"]
        if hours is not None:
            if as_of is None:
                raise ValueError("sort 'top' with a period needs as_of")
            submissions = submissions.filter(F.col("created_at") >= hours_before(as_of, hours))
    return first_per_group(submissions, ["subreddit"], order, limit, "id", rank)


def search_subreddits(
    submissions: DataFrame, subreddits: Sequence[str] | None = None, keywords: Sequence[str] = (),
    sort: str = "hot", time_filter: str | None = None, max_results: int = 100,
    min_upvotes: int = 0, min_comments: int = 0, hours_back: int | None = None,
    as_of: Column | datetime | None = None, ranked: bool = True,
) -> DataFrame:
    """Listing of twice the cap, then time, keywords and engagement, then the cap.

    All subreddits run in one job.  Both rankings use one partitioning by subreddit.  Not ``ranked``,
    the result has no ``listing_rank`` where the listing is staged: both caps follow the order of the
    listing, and no text is shuffled for them where no subreddit exceeds them.
    """
    if subreddits is not None:
        submissions = submissions.filter(F.col("subreddit").isin(*subreddits))
    staged = max_results * 2 > DIRECT_LIMIT
    rank = "listing_rank" if ranked or not staged else None
    found = listing(submissions, sort, as_of, time_filter, max_results * 2, rank)
    if hours_back:
        if as_of is None:
            raise ValueError("hours_back needs as_of")
        found = found.filter(F.col("created_at") >= hours_before(as_of, hours_back))
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    found = found.filter(
        contains_any(body, keywords)
        & (F.col("score") >= min_upvotes)
        & (F.col("num_comments") >= min_comments)
    )
    order = [rank] if rank else _listing_order(sort)
    # Counting by subreddit reads texts for keywords only; what has one is staged instead.
    return first_per_group(found, ["subreddit"], order, max_results, "id", staged=rank is None and not keywords)


def news_window(
    articles: DataFrame, as_of: Column | datetime, hours_back: int = 24, max_results: int = 100,
    sort_by: str = "publishedAt", domains: Sequence[str] = (),
) -> DataFrame:
    """Normalised articles of the last hours, newest first, capped per query.

    Hosts must match a domain exactly.  Filter landed articles by language before they are normalised;
    posts carry none.
    ``relevancy`` and ``popularity`` are rankings of the news service and use its landed
    ``position``.
    """
    found = articles.filter(F.col("created_at") >= hours_before(as_of, hours_back))
    if domains:
        found = found.filter(F.try_parse_url("article_url", F.lit("HOST")).isin(*domains))
    if sort_by == "publishedAt":
        order = [F.desc("created_at"), F.col("id")]
    elif sort_by in ("relevancy", "popularity"):
        order = [F.col("position"), F.col("id")]
    else:
        raise ValueError(f"invalid sort {sort_by!r}")
    return first_per_group(found, ["query"], order, max_results, "id")


def first_entries(entries: DataFrame, max_episodes: int = 20) -> DataFrame:
    """First entries of each feed, before parsing; at least one."""
    return first_per_group(entries, ["feed_url"], ["position"], max(max_episodes, 1), "position")


def episode_keywords(episodes: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Keyword filter over title and stored text, after parsing."""
    return episodes.filter(contains_any(F.concat_ws("\n", "episode_title", "text"), keywords))
