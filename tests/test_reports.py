from datetime import timedelta


from themeflow.operators import reports, store
from themeflow.plans import queries, runs
from tests.conftest import NOW


def summary(spark, rows, per_part=1000):
    documents = spark.createDataFrame(rows, "position long, title string, content string")
    parts = reports.corpus_summary(documents, "position", per_part).orderBy("part").collect()
    return "".join(r.text for r in parts)


def test_corpus_summary(spark):
    rows = [(0, "Story A", "Hello world"), (1, "Story B", "Another story content"), (2, None, None)]
    expected = "Narratives (3 items): Story A, Story B, <untitled>. Total word count: 5."
    assert summary(spark, rows) == expected
    assert summary(spark, rows, 1) == expected
    assert summary(spark, []) == "No narratives provided."


def test_sentiment_report(make_posts):
    posts = make_posts(
        {"id": "1", "text": "bullish rally", "cashtags": ["BTC"]}, {"id": "2", "text": "bullish breakout", "cashtags": ["BTC"]}
    )
    row = reports.sentiment_report(runs.analyse(posts, NOW).clusters).first()
    assert (row.name, row.label, row.sentiment_score, row.n_posts) == ("$BTC narrative momentum", "BULLISH", 0.6667, 2)
    assert (row.cashtags, row.keywords) == ("BTC", "bullish, rally, breakout")


def test_ingest_summary(spark, make_posts):
    results = spark.createDataFrame(
        [("twitter", NOW, NOW + timedelta(seconds=1.26), 3, 1, ["a", "b", "c", "d"], True)],
        "source string, started_at timestamp, completed_at timestamp, posts_stored long, "
        "duplicates_skipped long, errors array<string>, success boolean",
    )
    row = reports.ingest_summary(results, store.stats(make_posts({"id": "1"}))).first()
    assert (row.duration_seconds, row.error_count, row.first_errors) == (1.3, 4, ["a", "b", "c"])
    assert (row.total_posts, row.twitter, row.unprocessed) == (1, 1, 1)


def test_the_summary_takes_its_durations_from_the_posts(spark, tmp_path):
    # Posts 0, 4 and 8 are tweets, post 1 is a submission; post 11 comes without an author as well.
    documents = [(n, f"text {n}", "en", "web", 6) for n in (0, 1, 4, 8, 11)]
    events = [(n, n, "view", NOW + timedelta(seconds=1.26 * n), 1.0) for n in (0, 1, 4, 8, 11)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.source: r for r in queries.QUERIES["ingest_summary"](spark, str(tmp_path)).collect()}
    assert {k: r.duration_seconds for k, r in rows.items()} == {
        "twitter": 10.1, "reddit": 0.0, "news": None, "podcast": 0.0, "letters": None
    }
    assert (rows["podcast"].first_errors, rows["letters"].posts_stored) == ("1 rows without author_id", 0)
