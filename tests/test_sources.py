import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from themeflow.operators import search
from themeflow.plans import fixtures, queries, runs
from themeflow.sources import forum, landed, news, podcast, tables, tweets
from tests.conftest import NOW


def land(path, *rows):
    path.write_text("\n".join(row if isinstance(row, str) else json.dumps(row) for row in rows))
    return str(path)


TWEET = {
    "id": "77001", "text": "Solar makers jump today $SOLR", "author_id": "41", "created_at": "2024-01-15T10:30:00.000Z",
    "public_metrics": {"like_count": 240, "retweet_count": 60, "reply_count": 20, "quote_count": 0,
                       "bookmark_count": 9, "impression_count": 8000},
    "lang": "en",
    "entities": {"cashtags": [{"tag": "SOLR"}, {"tag": "SOLR"}], "hashtags": [], "urls": [{"expanded_url": "https://x"}]},
}


def test_tweets(spark, tmp_path):
    page = {
        "query": "q", "page": 1,
        "data": [TWEET, {"id": "2", "text": "t", "created_at": "2024-01-15T10:30:00Z", "author_id": "1",
                         "in_reply_to_user_id": "5", "referenced_tweets": [{"type": "retweeted", "id": "9"}]},
                 {"id": "3", "text": "no date"}],
        "includes": {"users": [{"id": "41", "username": "old"}, {"id": "41", "username": "trader"}]},
    }
    pages = landed.read_tweet_pages(spark, land(tmp_path / "t.json", page, "not json"))
    rows = {r.id: r for r in tweets.normalise(pages, NOW).collect()}
    assert set(rows) == {"77001", "2"}
    first, second = rows["77001"], rows["2"]
    assert (first.author_username, first.likes, first.reposts, first.replies) == ("trader", 240, 60, 20)
    assert (first.cashtags, first.urls, first.engagement_rate) == (["SOLR", "SOLR"], ["https://x"], 0.04)
    assert (first.is_reply, first.is_retweet, first.created_at) == (False, False, datetime(2024, 1, 15, 10, 30))
    assert (second.author_username, second.likes, second.engagement_rate) == ("unknown", 0, None)
    assert (second.is_reply, second.is_retweet) == (True, True)


SUBMISSION = {
    "id": "k7", "author": "gardener", "title": "$WHT harvest is late", "selftext": "Rain again for $WHT (https://a.b/c) #crops",
    "created_utc": 1700000000, "score": 310, "num_comments": 44, "subreddit": "farming", "is_self": True,
    "url": "https://self.post", "downs": 7, "total_awards_received": 2, "permalink": "/r/farming/comments/k7/late",
}


def test_forum(spark, tmp_path):
    long = {**SUBMISSION, "id": "2", "author": None, "selftext": "x" * 5000 + " $END", "is_self": False}
    bare = {**SUBMISSION, "id": "3", "selftext": ""}
    rows = landed.read_submissions(spark, land(tmp_path / "s.json", SUBMISSION, long, bare))
    found = {r.id: r for r in forum.normalise(rows, NOW).collect()}
    first, second, third = found["reddit_k7"], found["reddit_2"], found["reddit_3"]
    assert first.text == SUBMISSION["title"] + "\n\n" + SUBMISSION["selftext"]
    assert (first.cashtags, first.hashtags, first.urls) == (["WHT"], ["crops"], ["https://a.b/c"])
    assert (first.likes, first.upvotes, first.replies, first.reposts) == (310, 310, 44, 0)
    assert first.permalink == "https://reddit.com/r/farming/comments/k7/late"
    assert first.created_at == datetime(2023, 11, 14, 22, 13, 20)
    assert (second.author_id, len(second.text), second.cashtags) == ("deleted", 4000, ["END", "WHT"])
    assert second.urls == ["https://self.post"]
    assert third.text == SUBMISSION["title"]


ARTICLE = {
    "source": {"id": "harbour", "name": "Harbour Post"}, "title": "Freight rates ease in spring",
    "description": "Two routes reopened.", "content": "Brokers watch $FRT #shipping.",
    "url": "https://harbour.example/freight", "publishedAt": "2026-03-04T12:00:00Z",
}


def test_news(spark, tmp_path):
    no_url = {k: v for k, v in ARTICLE.items() if k != "url"}
    odd = {**ARTICLE, "url": "https://odd", "publishedAt": "soon"}
    bare = {"url": "https://bare", "publishedAt": "2026-03-04T12:00:00+01:00", "content": "y" * 5000 + "$CUT"}
    rows = landed.read_articles(spark, land(tmp_path / "n.json", ARTICLE, no_url, odd, bare))
    found = {r.article_url: r for r in news.normalise(rows, NOW).collect()}
    assert set(found) == {ARTICLE["url"], "https://bare"}
    first, second = found[ARTICLE["url"]], found["https://bare"]
    assert first.id == "news_" + hashlib.sha1(ARTICLE["url"].encode()).hexdigest()[:16]
    assert first.text == "\n\n".join([ARTICLE["title"], ARTICLE["description"], ARTICLE["content"]])
    assert (first.cashtags, first.hashtags, first.author_id) == (["FRT"], ["shipping"], "harbour")
    assert (second.title, second.source_name, second.author_id) == ("https://bare", "unknown", "unknown")
    assert (len(second.text), second.cashtags, second.created_at) == (4000, [], datetime(2026, 3, 4, 11))


EPISODE = {
    "feed_url": "https://example.com/rss", "show_name": "Field Notes", "position": 0, "id": "note-1",
    "title": " Wheat and water ", "link": "https://example.com/notes/1",
    "published": "Thu, 05 Mar 2026 15:00:00 GMT", "summary": "On <b>$WHT</b> and #rain.",
    "description": "River levels.", "content": [{"value": "<p>River levels.</p>"}, {"value": ""}],
    "links": [{"href": "", "rel": "enclosure"}, {"href": "https://cdn.example.com/n1.mp3", "type": "Audio/mpeg"},
              {"href": "https://cdn.example.com/n1.vtt", "rel": "alternate", "type": "application/x-transcript"}],
}


def test_podcast(spark, tmp_path):
    no_id = {"feed_url": "f", "title": "No ID", "summary": "text"}
    no_text = {"feed_url": "f", "id": "x", "summary": " <br> "}
    fallback = {"feed_url": "f", "link": "https://l", "summary": "s", "published": "later",
                "updated_parsed": "2026-01-01T00:00:00Z"}
    undated = {"feed_url": "f", "guid": "g", "summary": "s"}
    rows = landed.read_episodes(spark, land(tmp_path / "p.json", EPISODE, no_id, no_text, fallback, undated))
    found = {r.episode_title: r for r in podcast.normalise(rows, NOW).filter("feed_url <> 'f'").collect()}
    first = found["Wheat and water"]
    assert first.id == "podcast_" + hashlib.sha1(b"https://example.com/rss:note-1").hexdigest()[:16]
    assert first.text == "River levels.\n\nOn $WHT and #rain."
    assert (first.cashtags, first.hashtags, first.show_name) == (["WHT"], ["rain"], "Field Notes")
    assert first.audio_url == "https://cdn.example.com/n1.mp3"
    assert first.transcript_source == "https://cdn.example.com/n1.vtt"
    assert first.urls == [EPISODE["link"], first.audio_url]
    assert first.created_at == datetime(2026, 3, 5, 15)
    rest = podcast.normalise(rows, NOW).filter("feed_url = 'f'").orderBy("created_at").collect()
    assert [r.created_at for r in rest] == [datetime(2026, 1, 1), NOW.replace(tzinfo=None)]
    assert {(r.episode_title, r.show_name, r.transcript_source) for r in rest} == {
        ("Untitled Episode", "unknown", "rss:description")
    }


FEED = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Field Notes</title>
<item><guid>g1</guid><title>One</title><link>https://e/1</link><pubDate>Thu, 05 Mar 2026 15:00:00 GMT</pubDate>
<description>&lt;p&gt;$WHT talk&lt;/p&gt;</description><enclosure url="https://e/1.mp3" type="audio/mpeg"/></item>
<item><guid>g2</guid><title>Two</title><description>more</description><dc:date>2026-03-04T12:00:00Z</dc:date></item>
</channel></rss>"""


def test_feed_files(spark, tmp_path):
    folder = tmp_path / "feeds" / "feed_url=https%3A%2F%2Fe%2Frss"
    folder.mkdir(parents=True)
    (folder / "feed.xml").write_text(FEED)
    entries = landed.read_feeds(spark, str(tmp_path / "feeds"))
    config = runs.IngestConfig(podcast_feeds=["https://e/rss"], podcast_max_episodes=1)
    rows = runs.ingest_podcasts(entries, config, NOW).collect()
    assert [(r.episode_title, r.text, r.audio_url, r.show_name) for r in rows] == [
        ("One", "$WHT talk", "https://e/1.mp3", "Field Notes")
    ]
    dated = {r.episode_title: r.created_at for r in podcast.normalise(entries, NOW).collect()}
    assert dated == {"One": datetime(2026, 3, 5, 15), "Two": datetime(2026, 3, 4, 12)}


def test_titles_and_order_of_feed_files(spark, tmp_path):
    """Titles of items and images are none of the channel; a feed without one has none; files follow their paths."""
    root = tmp_path / "feeds"
    item = "<item><guid>{0}</guid><title>{0}</title><description>text</description></item>"
    files = {
        "a/2.xml": "<rss><channel>" + item.format("a3") + "<image><title>Logo</title></image><title> Late &amp; short </title></channel></rss>",
        "a/1.xml": "<rss><channel><title>Early</title>" + item.format("a1") + item.format("a2") + "</channel></rss>",
        "b/1.xml": "<rss><channel>" + item.format("b1") + "</channel></rss>",
    }
    for name, text in files.items():
        target = root / f"feed_url={name}"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    entries = landed.read_feeds(spark, str(root))
    found = podcast.normalise(entries, NOW).collect()
    assert {(r.feed_url, r.episode_title, r.show_name) for r in found} == {
        ("a", "a1", "Early"), ("a", "a2", "Early"), ("a", "a3", "Late & short"), ("b", "b1", "unknown"),
    }
    first = search.first_entries(entries, 2)
    assert sorted(r.title for r in first.collect()) == ["a1", "a2", "b1"]


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Field Notes</title>
<entry><id>a1</id><title>Rivers</title><link href="https://e/a1"/><link rel="enclosure" type="audio/mpeg" href="https://e/a1.mp3"/>
<published>2026-03-04T12:00:00Z</published><summary>Low $WTR levels</summary></entry>
<entry><id>a2</id><title>Locks</title><link href="https://e/a2"/><updated>2026-03-03</updated><content>closed</content></entry>
</feed>"""


def test_atom_files(spark, tmp_path):
    folder = tmp_path / "feeds" / "feed_url=https%3A%2F%2Fe%2Fatom"
    folder.mkdir(parents=True)
    (folder / "feed.xml").write_text(ATOM)
    found = podcast.normalise(landed.read_atom(spark, str(tmp_path / "feeds")), NOW).orderBy("episode_title").collect()
    assert {r.show_name for r in found} == {"Field Notes"}
    assert [(r.episode_title, r.text, r.audio_url, r.episode_url, r.created_at) for r in found] == [
        ("Locks", "closed", None, "https://e/a2", datetime(2026, 3, 3)),
        ("Rivers", "Low $WTR levels", "https://e/a1.mp3", "https://e/a1", datetime(2026, 3, 4, 12)),
    ]


def test_a_run_uses_the_sources_that_are_configured(spark, tmp_path):
    sources = {
        "twitter": landed.read_tweet_pages(spark, land(tmp_path / "t.json", {
            "query": "q", "page": 1, "data": [TWEET], "includes": {"users": []}})),
        "reddit": landed.read_submissions(spark, land(tmp_path / "s.json", {**SUBMISSION, "rank": 1})),
    }
    as_of = datetime(2024, 1, 15, 12)
    config = runs.IngestConfig(twitter_queries=["q"], reddit_subreddits=["farming"], hours_back=24 * 365)
    rows = runs.ingest(sources, config, as_of).collect()
    assert {r.platform for r in rows} == {"twitter", "reddit"}
    only = runs.IngestConfig(twitter_queries=["q"], reddit_subreddits=["farming"], reddit_enabled=False, hours_back=24)
    assert only.enabled_sources() == ["twitter"]
    assert [r.platform for r in runs.ingest(sources, only, as_of).collect()] == ["twitter"]
    assert runs.ingest(sources, runs.IngestConfig(), as_of) is None
    assert runs.ingest(sources, runs.IngestConfig(twitter_queries=["q"], twitter_min_likes=241), as_of).count() == 0


def test_base_and_extension_columns(spark, tmp_path):
    rows = landed.read_submissions(spark, land(tmp_path / "s.json", SUBMISSION))
    wide = tables.unify([forum.normalise(rows, NOW)])
    assert tables.base_posts(wide).first().id == "reddit_k7"
    assert tables.extension(wide, "reddit").first().subreddit == "farming"


def small_tables(spark, path, n):
    """``n`` documents of four sources and their events."""
    rows = spark.range(n)
    rows.select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit("en").alias("lang"),
        F.lit(9).alias("n_chars"), F.concat(F.lit("a <b>& word"), "id").alias("text"),
    ).write.parquet(f"{path}/documents.parquet")
    rows.select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"),
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_a_landed_file_holds_a_page_of_its_own_feed(spark, tmp_path, monkeypatch):
    # 100 documents of each of two feeds; pages of document numbers over all feeds gave 20 files for each.
    monkeypatch.setattr(fixtures, "FEED_PAGE", 20)
    fixtures.land_feeds(spark, small_tables(spark, tmp_path, 400), f"{tmp_path}/feeds")
    files = {form: list((tmp_path / "feeds" / form).glob("*/*/*.txt")) for form in ("rss", "atom")}
    for form, tag in (("rss", "<item>"), ("atom", "<entry>")):
        sizes = [f.read_text().count(tag) for f in files[form]]
        assert sum(sizes) == 200 and max(sizes) <= 20 and len(sizes) <= 2 * 6
    entries = landed.read_feeds(spark, f"{tmp_path}/feeds/rss")
    first = search.first_entries(entries, 3).select("feed_url", F.regexp_extract("link", "[0-9]+$", 0).cast("int").alias("doc"))
    assert sorted(r.doc for r in first.collect()) == [0, 2, 4, 6, 8, 10]


def test_equal_chunks_of_an_episode_count_once(spark):
    schema = "content array<struct<value: string>>, summary string, description string"
    rows = [([("<p>a  b</p>",), ("c",)], "a b", "a b"), ([("",)], None, "x"), (None, "x", "x"), (None, None, None), ([(None,)], "<p>", "y")]
    found = spark.createDataFrame(rows, schema).select(podcast.transcript_text().alias("t"))
    assert [r.t for r in found.collect()] == ["a b\n\nc", "x", "x", "", "y"]


def test_scores_of_themes_count_no_words(spark, tmp_path, monkeypatch):
    sf_dir = small_tables(spark, tmp_path, 40)
    expected = queries.QUERIES["narrative_overall"](spark, sf_dir).count()
    monkeypatch.setattr(queries.cluster, "top_keywords", None)
    for name in ("velocity", "saturation", "narrative_scores", "narrative_sentiment"):
        assert queries.QUERIES[name](spark, sf_dir).count() == expected > 0
