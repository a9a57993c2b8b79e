"""The physical plans that large inputs rely on."""

import re

import pytest
from pyspark.sql import functions as F

from themeflow.operators import cluster, ranking, search, sentiment, store
from tests.test_cluster import random_posts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



@pytest.fixture
def posts(make_posts, tmp_path, spark):
    path = str(tmp_path / "posts")
    found = make_posts(*random_posts(1, 40))
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def test_keywords_are_hashed_and_cut_before_the_shuffle(posts):
    text = plan(cluster.top_keywords(posts))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert re.search(r"WindowGroupLimit \[key.*row_number\(\), 8, Partial", text)
    assert "ReadSchema: struct<id:string,text:string,created_at:timestamp,cashtags:array<string>>" in text
    # One split of each text: no size filter at the scan.
    assert "size(" not in text.split("FileScan")[1]


def test_terms_are_hashed(posts):
    assert "SortAggregate" not in plan(sentiment.top_terms(posts))


def test_copies_are_cut_before_the_shuffle(posts):
    text = plan(store.new_posts(posts.withColumn("arrival", F.lit(1)), posts, "arrival"))
    assert re.search(r"WindowGroupLimit \[id.*row_number\(\), 1, Partial", text)
    assert "PushedFilters: [IsNotNull(id)" in text


def test_caps_share_one_partitioning(posts):
    forum = posts.select(
        "id", F.col("author_id").alias("subreddit"), F.col("text").alias("title"), F.col("text").alias("selftext"),
        "created_at", F.col("likes").alias("score"), F.col("replies").alias("num_comments"),
    )
    text = plan(search.search_subreddits(forum, sort="new", max_results=5, keywords=["word1"]))
    assert text.count("Exchange hashpartitioning(subreddit") == 1


def test_extensions_move_posts_once(spark, posts):
    from themeflow import schemas

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.EXTENSIONS.items()}
        text = plan(store.with_extensions(posts, tables))
        assert len(re.findall(r"Exchange hashpartitioning\(id#", text)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stats_are_one_pass(posts):
    assert plan(store.stats(posts)).count("FileScan") == 1


def test_no_cross_joins_and_no_python(posts):
    assigned = cluster.assign(posts)
    text = plan(cluster.cluster(posts, assigned))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert operator not in text


def test_a_small_batch_leaves_the_store_in_place(spark, posts):
    batch = posts.limit(20).withColumn("arrival", F.monotonically_increasing_id())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(store.known_ids(batch, posts))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert "SortMergeJoin" in plan(store.known_ids(batch, posts, broadcast_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_summary_scans_the_store_once(posts):
    from themeflow.operators import reports

    results = store.load_report(posts.withColumn("arrival", F.lit(1)), None, "arrival")
    staged = results.sparkSession.createDataFrame(results.collect(), results.schema)
    assert plan(reports.ingest_summary(staged, store.stats(posts))).count("FileScan") == 1


def test_limits_beyond_the_direct_one_cut_each_group_in_parts(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("g"))

    def firsts(direct_limit):
        found = ranking.first_per_group(rows, ["g"], [F.desc("id")], 1200, "id", "rank", direct_limit)
        return found, sorted(tuple(r) for r in found.collect())

    direct, expected = firsts(5000)
    split, found = firsts(1000)
    assert found == expected and len(found) == 2200
    assert re.search(r"Exchange hashpartitioning\(_salt.*, g", plan(split))


def test_high_limits_rank_in_ranges(spark):
    # A group that holds nearly all rows is numbered in several ranges; ranks are those of a plain window.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 == 0, F.lit("b")).when(F.col("id") % 97 != 0, F.lit("a")).alias("g"),
        F.floor((F.col("id") * 7919) % 1000).alias("o"), F.col("id").cast("string").alias("id"), F.lit("text").alias("text"),
    )
    order = [F.desc("o"), F.col("id")]
    for limit in (25, 400, 10_000):
        plain = ranking.first_per_group(rows, ["g"], order, limit, "id", "rank", direct_limit=10_000)
        found = ranking.first_per_group(rows, ["g"], order, limit, "id", "rank", direct_limit=10)
        assert found.columns == plain.columns and found.schema["rank"].dataType == plain.schema["rank"].dataType
        expected = sorted(map(tuple, plain.collect()), key=repr)
        assert sorted(map(tuple, found.collect()), key=repr) == expected
        unranked = ranking.first_per_group(rows, ["g"], order, limit, "id", direct_limit=10)
        assert sorted(map(tuple, unranked.collect()), key=repr) == [x[:-1] for x in expected]
        # No task numbers the rows of a whole group.
        for df in (found, unranked):
            assert "row_number" not in plan(df)
