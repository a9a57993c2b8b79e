from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from themeflow.operators import search
from tests.conftest import NOW


def test_engagement_thresholds(make_posts):
    posts = make_posts({"id": "1", "likes": 50, "reposts": 20, "replies": 5})

    def passes(**least):
        return search.engagement_filter(posts, least).count() == 1

    assert passes(likes=10) and passes(likes=50) and passes(quotes=999) and passes()
    assert not passes(likes=100) and not passes(retweets=50) and not passes(likes=1, replies=6)


def test_filter_comes_before_the_cap(make_posts):
    posts = make_posts(*[{"id": str(i), "likes": i, "minutes_ago": i} for i in range(10)])
    posts = posts.withColumns({"query": F.lit("q"), "arrival": F.col("id").cast("int")})
    found = search.capped_search(posts, 2, "arrival", thresholds={"likes": 3})
    assert sorted(r.id for r in found.collect()) == ["3", "4"]
    ranged = search.capped_search(
        posts, 9, "arrival", start=NOW - timedelta(minutes=5), end=NOW - timedelta(minutes=4)
    )
    assert sorted(r.id for r in ranged.collect()) == ["4", "5"]


def submissions(spark, rows):
    return spark.createDataFrame(
        [(id, sub, title, body, NOW - timedelta(hours=hours), score, comments, rank)
         for rank, (id, sub, title, body, hours, score, comments) in enumerate(rows)],
        "id string, subreddit string, title string, selftext string, created_at timestamp, "
        "score long, num_comments long, rank long",
    )


ROWS = [
    ("a", "btc", "ETF", None, 1, 5, 2), ("b", "btc", "none", "about etf", 2, 50, 0),
    ("c", "btc", "none", "", 3, 70, 9), ("d", "btc", "etf", "", 40, 90, 9),
    ("e", "eth", "etf", "", 1, 9, 9), ("f", "btc", "etf", "", 4, 80, 9),
]


def test_forum_search_scans_twice_the_cap(spark):
    posts = submissions(spark, ROWS)

    def ids(**kwargs):
        return sorted(r.id for r in search.search_subreddits(posts, **kwargs).collect())

    assert ids(subreddits=["btc"], keywords=["ETF"], max_results=2) == ["a", "b"]
    assert ids(keywords=["etf"], max_results=9) == ["a", "b", "d", "e", "f"]
    assert ids(subreddits=["btc"], keywords=["etf"], max_results=1, min_upvotes=60) == []
    assert ids(subreddits=["btc"], max_results=9, hours_back=24, min_comments=9, as_of=NOW) == ["c", "f"]
    assert ids(subreddits=["btc"], sort="top", max_results=1, as_of=NOW) == ["f"]


def test_listings(spark):
    posts = submissions(spark, ROWS).filter("subreddit = 'btc'")

    def ids(*args):
        return [r.id for r in search.listing(posts, *args).orderBy("listing_rank").collect()]

    assert ids("new") == ["a", "b", "c", "f", "d"]
    assert ids("top", NOW) == ["f", "c", "b", "a"]
    assert ids("top", NOW, "all") == ["d", "f", "c", "b", "a"]
    assert ids("hot", None, None, 2) == ["a", "b"]
    with pytest.raises(ValueError):
        search.listing(posts, "best")


def test_news_window(spark):
    articles = spark.createDataFrame(
        [(str(i), "q", NOW - timedelta(hours=i * 10), f"https://{host}/x", i)
         for i, host in enumerate(["a.com", "b.com", "a.com", "a.com"])],
        "id string, query string, created_at timestamp, article_url string, position long",
    )
    found = search.news_window(articles, NOW, 24, 2)
    assert sorted(r.id for r in found.collect()) == ["0", "1"]
    found = search.news_window(articles, NOW, 24, 5, domains=["a.com"])
    assert sorted(r.id for r in found.collect()) == ["0", "2"]


def test_feed_cap_counts_entries_before_they_are_filtered(spark):
    entries = spark.createDataFrame([("f", i) for i in range(5)], "feed_url string, position long")
    assert sorted(r.position for r in search.first_entries(entries, 2).collect()) == [0, 1]
    assert search.first_entries(entries, 0).count() == 1


def test_high_caps_of_a_forum_need_no_rank(spark):
    posts = submissions(spark, [(f"{i:04}", "btc" if i % 9 else "eth", "t", "b", (i * 37) % 2500, i % 50, 1) for i in range(2500)])

    def found(cap, ranked):
        return search.search_subreddits(posts, None, (), "new", max_results=cap, min_upvotes=3, ranked=ranked)

    for cap in (400, 600, 1100, 3000):
        expected = found(cap, True)
        ids = found(cap, False)
        assert ("listing_rank" in ids.columns) == (cap == 400)
        assert sorted(ids.drop("listing_rank").collect()) == sorted(expected.drop("listing_rank").collect())
    # Where no cap is exceeded, staged rows are the result.
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
