import pytest
from pyspark.sql import functions as F

from themeflow import schemas
from themeflow.operators import store
from themeflow.plans import runs
from themeflow.sources import tables


def numbered(posts):
    return posts.withColumn("arrival", F.monotonically_increasing_id())


def test_first_write_wins_across_platforms(spark, make_posts):
    first = numbered(make_posts({"id": "1", "text": "a"}, {"id": "1", "text": "b", "platform": "news"}, {"id": "2"}))
    fresh = store.new_posts(first, None, "arrival")
    assert {(r.id, r.text) for r in fresh.collect()} == {("1", "a"), ("2", "")}
    second = numbered(make_posts({"id": "2", "text": "again"}, {"id": "3"}))
    assert [r.id for r in store.new_posts(second, fresh, "arrival").collect()] == ["3"]


def test_load_report_counts_incomplete_rows_apart(spark, make_posts):
    batch = numbered(make_posts({"id": "1"}, {"id": "1"}, {"id": "2"}, {"id": "3", "platform": "news"}))
    broken = batch.withColumn("text", F.when(F.col("id") != "2", F.col("text")))
    stored = make_posts({"id": "3"})
    fresh, report = runs.load(broken, stored, "arrival")
    assert [r.id for r in fresh.collect()] == ["1"]
    assert {tuple(r) for r in report.drop("errors", "success", "started_at", "completed_at").collect()} == {("twitter", 1, 1, 1), ("news", 0, 1, 0)}
    errors = {r.source: (r.errors, r.success) for r in report.collect()}
    assert errors == {"twitter": (["1 rows without text"], True), "news": ([], True)}
    wide = store.load_report(broken, stored, "arrival", configured=("twitter", "podcast"))
    assert {(r.source, r.posts_stored, r.rejected) for r in wide.collect()} == {("twitter", 1, 1), ("podcast", 0, 0)}


def test_look_ups(make_posts):
    posts = make_posts(
        {"id": "1"}, {"id": "2", "minutes_ago": 9}, {"id": "3", "processed": True},
        {"id": "4", "platform": "fax"}, {"id": "5", "platform": "news", "minutes_ago": 1},
    )
    assert store.post_by_id(posts, "1").count() == 1
    assert store.post_by_id(posts, "4").count() == 0
    assert store.post_by_id(posts, "x").count() == 0
    assert store.tweet_by_id(posts, "1").count() == 1
    assert store.tweet_by_id(posts, "5").count() == 0
    # The unknown platform takes a place of the limit.
    assert [r.id for r in store.unprocessed(posts, 3).collect()] == ["1", "5"]
    assert [r.id for r in store.unprocessed(posts, 10, "twitter").collect()] == ["1", "2"]


def test_mark_processed_counts_marked_posts_again(spark, make_posts):
    posts = make_posts({"id": "1"}, {"id": "2", "processed": True}, {"id": "3"})
    ids = spark.createDataFrame([("1",), ("2",), ("2",), ("x",)], "id string")
    marked = store.mark_processed(posts, ids)
    assert {(r.id, r.processed) for r in marked.collect()} == {("1", True), ("2", True), ("3", False)}
    assert store.count_marked(posts, ids).first().marked == 2
    assert [r.id for r in store.without_processed(posts, ids).collect()] == ["3"]


def test_stats(make_posts):
    posts = make_posts({"id": "1"}, {"id": "2", "processed": True}, {"id": "3", "platform": "podcast"})
    assert store.stats(posts).first().asDict() == {
        "total_posts": 3, "total_tweets": 2, "unprocessed": 2, "processed": 1, "twitter": 2,
        "reddit": 0, "news": 0, "podcast": 1,
    }


def test_defaults_of_missing_extensions(spark, make_posts):
    posts = make_posts(
        {"id": "t"}, {"id": "r", "platform": "reddit"},
        {"id": "n", "platform": "news", "text": "x" * 200}, {"id": "p", "platform": "podcast", "text": "y" * 200},
    ).withColumn("urls", F.when(F.col("id") == "n", F.array(F.lit("https://u"))).otherwise(F.col("urls")))
    nothing = {name: spark.createDataFrame([], schema) for name, schema in schemas.EXTENSIONS.items()}
    rows = {r.id: r for r in store.with_extensions(posts, nothing).collect()}
    assert (rows["t"].impressions, rows["t"].is_reply, rows["t"].engagement_rate) == (0, False, None)
    assert (rows["r"].subreddit, rows["r"].is_self, rows["r"].title) == ("", True, None)
    assert (rows["n"].source_name, rows["n"].title, rows["n"].article_url) == ("unknown", "x" * 120, "https://u")
    assert (rows["p"].show_name, rows["p"].episode_title) == ("unknown", "y" * 120)
    assert rows["t"].is_self is None


def test_an_extension_of_another_platform_is_not_used(spark, make_posts):
    posts = make_posts({"id": "1"})
    reddit = spark.createDataFrame(
        [("1", "btc", "t", 1, 0, 0, False, "/x")], schemas.EXTENSIONS["reddit"]
    )
    assert store.with_extensions(posts, {"reddit": reddit}).first().subreddit is None


def test_tables_round_trip(spark, make_posts, tmp_path):
    posts = make_posts({"id": "1", "cashtags": ["BTC"]}, {"id": "2", "platform": "news"})
    path = str(tmp_path / "posts")
    tables.write_posts(posts, path)
    back = tables.read_table(spark, path, schemas.POSTS)
    assert sorted(back.select(*schemas.POST_COLUMNS).collect()) == sorted(posts.collect())
    plan = back.filter("platform = 'news'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan


def test_staged_folders_can_be_removed(spark):
    from themeflow.operators import staging

    staging.remove_staged(spark)
    table = staging.stage(spark.range(3), "numbers")
    assert table.count() == 3
    assert staging.remove_staged(spark) == 1 and staging.remove_staged(spark) == 0


def posts_by_day(make_posts, path):
    """Two posts a day on four days, a busy one, and a platform that only old days have."""
    rows = [{"id": f"d{day}-{i}", "minutes_ago": 1440 * day + i, "processed": day == 0 and i == 1} for day in range(4) for i in range(2)]
    rows += [{"id": "old", "platform": "news", "minutes_ago": 1440 * 9}]
    rows += [{"id": f"busy{i}", "text": "x" * 3000 + str(i), "minutes_ago": 1440 * 5} for i in range(3000)]
    tables.write_posts(make_posts(*rows), path)


def test_a_busy_day_is_written_by_many_tasks(spark, make_posts, tmp_path):
    path, settings = str(tmp_path / "posts"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(settings, "64k")
    try:
        posts_by_day(make_posts, path)
    finally:
        spark.conf.unset(settings)
    files = {}
    for name in spark.read.parquet(path).inputFiles():
        day = name.split("created_date=")[1].split("/")[0]
        files[day] = files.get(day, 0) + 1
    assert files["2026-03-05"] > 3 and all(n == 1 for day, n in files.items() if day != "2026-03-05")


def test_newest_unprocessed_posts_read_the_newest_days(spark, make_posts, tmp_path):
    path = str(tmp_path / "posts")
    posts_by_day(make_posts, path)
    stored = spark.read.schema(schemas.POSTS).parquet(path)
    days = tables.stored_days(spark, path)
    assert len(days) == 6 and days == sorted(days, reverse=True)
    for limit, platform in ((1, None), (4, None), (9, None), (4000, None), (5, "news"), (3, "podcast")):
        found = store.unprocessed_newest(stored, days, limit, platform)
        expected = store.unprocessed(stored, limit, platform)
        assert [r.id for r in found.collect()] == [r.id for r in expected.collect()]
    few = store.unprocessed_newest(stored, days, 3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    read = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "2026-03-10" in read or "20522" in read
    assert "2026-03-05" not in read and "2026-03-01" not in read
    marks = spark.createDataFrame([("d0-0",), ("d1-0",)], "id string")
    assert [r.id for r in store.unprocessed_newest(stored, days, 2, marks=marks).collect()] == ["d1-1", "d2-0"]
    assert store.unprocessed_newest(stored, [], 5).count() == 0
    assert tables.stored_days(spark, str(tmp_path / "nothing")) == []


def test_numbers_of_posts_are_sent_as_bits(spark):
    numbers = [0, 1, 63, 64, 65, 127, 128, 1 << 33, (1 << 33) + 5, (3 << 59) + (7 << 33) + 63]
    batch = spark.createDataFrame([(n, f"text {n}") for n in numbers], "arrival long, text string")
    chosen = numbers[::2]
    arrivals = spark.createDataFrame([(n,) for n in chosen], "arrival long")
    for most in (store.BROADCAST_BYTES, 0):
        found = store.of_arrivals(batch, arrivals, "arrival", most)
        assert found.columns == batch.columns
        assert sorted((r.arrival, r.text) for r in found.collect()) == [(n, f"text {n}") for n in sorted(chosen)]
    assert store.of_arrivals(batch, arrivals.limit(0), "arrival").count() == 0


def test_platforms_written_apart_are_all_written(spark, make_posts, tmp_path):
    path = str(tmp_path / "posts")
    platforms = ["twitter", "news", "news", "letters", None]
    posts = make_posts(*[{"id": str(i), "text": f"text {i}", "minutes_ago": 900 * i} for i in range(5)])
    named = F.element_at(F.lit(platforms[:4]), F.col("id").cast("int") + 1)
    posts = posts.withColumn("platform", F.when(F.col("id") != "4", named))
    for mode in ("append", "overwrite", "append"):
        tables.write_posts(posts, path, mode, "zstd", ("twitter", "reddit", "news"))
    found = spark.read.parquet(path).collect()
    expected = [(str(i), f"text {i}", name) for i, name in enumerate(platforms) for _ in range(2)]
    assert sorted((r.id, r.text, r.platform) for r in found) == expected
    with pytest.raises(ValueError):
        tables.write_posts(posts, path, "error", apart=("twitter",))
