"""Counts that jobs collect themselves, and the report of a run made of them."""

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from themeflow import schemas
from themeflow.operators.id_index import IdIndex
from themeflow.operators.observed import Watch, keep
from themeflow.operators.staging import staging_root
from themeflow.plans import runs
from tests.conftest import NOW


def test_rows_are_counted_by_their_first_reason(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, None), (4, None), (5, "c")], "id long, text string")
    watch = Watch()
    reasons = {"id": F.col("id").isNull(), "text": F.col("text").isNull()}
    assert keep(rows, reasons, watch, "rows").count() == 2
    assert watch.counts("rows") == {"rows": 5, "id": 2, "text": 1}
    assert watch.counts("nothing") == {}
    assert keep(rows, reasons, None, "rows").count() == 2
    # A condition that is unknown drops its row, as a filter would.
    assert keep(rows, {"b": F.col("text") == "b"}, watch, "unknown").count() == 2
    with pytest.raises(ValueError):
        watch.seen(rows, "rows", {})


def tweet(id, text="text", created="2026-03-10T11:00:00Z"):
    return (id, text, "a", created, "en", None, (50, 0, 0, 0, 0, 0), None, None)


def pages(spark, *tweets):
    rows = [("q", 0, list(tweets), ([("a", "anna")],)), (None, None, None, None), ("other", 1, [tweet("99")], ([],))]
    return spark.createDataFrame(rows, schemas.TWEET_PAGE)


def test_report_of_a_run(spark, tmp_path):
    landed = {"twitter": pages(spark, tweet("1"), tweet("1"), tweet("2"), tweet(None), tweet("3", created="?"), tweet("4"))}
    written = []
    ticks = iter([NOW, NOW + timedelta(seconds=3)])
    index = IdIndex(str(tmp_path / "ids"))
    index.add(spark.createDataFrame([("4",)], "id string"), 0)
    config = runs.IngestConfig(twitter_queries=["q"], reddit_subreddits=["x"])
    report = runs.run_ingest(
        landed, config, NOW, index, lambda posts: written.extend(r.id for r in posts.collect()), lambda: next(ticks)
    ).collect()
    assert sorted(written) == ["1", "2"] and len(report) == 1
    row = report[0].asDict()
    assert row.pop("started_at") + timedelta(seconds=3) == row.pop("completed_at")
    assert row == {
        "source": "twitter", "posts_stored": 2, "duplicates_skipped": 2, "rejected": 0, "success": True,
        "errors": ["1 unreadable lines", "1 records without id", "1 records without date"],
        "landed": 3, "unreadable": 1, "dropped": 2,
    }


def test_a_run_that_finds_nothing(spark):
    landed = {"twitter": pages(spark).limit(0)}
    report = runs.run_ingest(landed, runs.IngestConfig(twitter_queries=["q"]), NOW, None, lambda posts: posts.count())
    row = report.first()
    assert (row.posts_stored, row.landed, row.errors, row.success) == (0, 0, [], True)
    nothing = runs.run_ingest(landed, runs.IngestConfig(), NOW, None, lambda posts: None)
    assert nothing.count() == 0


def submission(id, title="title", subreddit="x"):
    row = {"id": id, "title": title, "subreddit": subreddit, "author": "a", "score": 9, "num_comments": 2, "created_utc": NOW.timestamp()}
    return tuple(row.get(name) for name in schemas.SUBMISSION.fieldNames())


def test_a_run_keeps_one_copy_of_its_texts(spark):
    landed = {
        "twitter": pages(spark, tweet("1"), tweet("1"), tweet("reddit_7"), tweet("2")),
        "reddit": spark.createDataFrame([submission("7"), submission("8"), submission("8"), submission("9")], schemas.SUBMISSION),
    }
    config = runs.IngestConfig(
        twitter_queries=["q"], twitter_max_results=10**9, reddit_subreddits=["x"], reddit_sort="new", reddit_max_results=10**9,
    )
    folder = Path(staging_root(spark), "themeflow")
    before, left, plans, written = set(folder.glob("*")), set(), [], []

    def write(posts):
        left.update(path.name.rpartition("-")[0] for path in set(folder.glob("*")) - before)
        plans.append(posts._jdf.queryExecution().executedPlan().toString())
        written.extend((r.id, r.platform) for r in posts.collect())

    stored = spark.createDataFrame([("2",)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = runs.run_ingest(landed, config, NOW, stored, write).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Of an id in two sources the first one's post is stored.
    assert sorted(written) == [("1", "twitter"), ("reddit_7", "twitter"), ("reddit_8", "reddit"), ("reddit_9", "reddit")]
    assert [(r.source, r.posts_stored, r.duplicates_skipped, r.rejected) for r in report] == [("twitter", 2, 2, 0), ("reddit", 2, 2, 0)]
    # Rows staged for the caps are gone, and texts aren't shuffled to find those that are stored.
    assert {"incoming-twitter", "incoming-reddit"} <= left and not {"rows-to-rank", "numbered-rows"} & left
    assert "Exchange hashpartitioning" not in plans[0] and "SortMergeJoin" not in plans[0]
