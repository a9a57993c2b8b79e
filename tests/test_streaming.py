import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from themeflow import schemas
from themeflow.operators import cluster, lifecycle, scoring
from themeflow.operators.id_index import IdIndex
from themeflow.streaming import ingest, velocity
from themeflow.streaming import lifecycle as stream_lifecycle
from tests.conftest import NOW


def run_to_end(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def numbered(posts):
    return posts.withColumn("arrival", F.monotonically_increasing_id())


def test_ingest_equals_the_batch_over_all_files(spark, make_posts, tmp_path):
    landing, out, log = (str(tmp_path / name) for name in ("landing", "out", "log"))
    first = numbered(make_posts({"id": "1", "text": "a"}, {"id": "1", "text": "b"}, {"id": "2"}))
    second = numbered(make_posts({"id": "2", "text": "late"}, {"id": "3"}))
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(first.schema).parquet(landing)
        run_to_end(ingest.ingest_stream(stream, out, "arrival", log))
    rows = {(r.id, r.text) for r in spark.read.schema(first.schema).parquet(out).collect()}
    assert rows == {("1", "a"), ("2", ""), ("3", "")}
    # A batch that is run again replaces its own rows.
    ingest.write_batch(second, 1, out, "arrival", IdIndex(f"{out}-ids"))
    assert {(r.id, r.text) for r in spark.read.schema(first.schema).parquet(out).collect()} == rows


def test_bounded_deduplication(spark, make_posts, tmp_path):
    landing = str(tmp_path / "landing")
    make_posts({"id": "1"}, {"id": "1"}, {"id": "2"}).write.parquet(landing)
    stream = spark.readStream.schema(schemas.POSTS).parquet(landing)
    run_to_end(
        ingest.deduplicated_within(stream, "1 hour").writeStream.format("memory").queryName("bounded")
        .option("checkpointLocation", str(tmp_path / "log"))
    )
    assert sorted(r.id for r in spark.table("bounded").collect()) == ["1", "2"]


def themes_of(posts):
    return cluster.as_narratives(cluster.cluster(posts, cluster.assign(posts), min_size=1))


def test_lifecycle_equals_the_replayed_batches(spark, make_posts, tmp_path):
    landing, out, log = (str(tmp_path / name) for name in ("landing", "out", "log"))
    batches = [
        make_posts({"id": "1", "cashtags": ["BTC"], "minutes_ago": 6000}, {"id": "2", "cashtags": ["ETH"], "minutes_ago": 6000}),
        make_posts({"id": "1", "cashtags": ["BTC"], "minutes_ago": 50}),
        make_posts({"id": "2", "cashtags": ["ETH"]}),
    ]
    state, expected = lifecycle.empty_state(spark), set()
    for posts in batches:
        as_of = posts.agg(F.max("created_at")).first()[0]
        merged = lifecycle.reconcile(state, themes_of(posts), F.lit(as_of).cast("timestamp"), 48)
        state = merged.state
        expected |= {tuple(r) for r in merged.log.collect()}
        posts.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schemas.POSTS).parquet(landing)
        run_to_end(stream_lifecycle.theme_stream(stream, out, f"{log}-themes", themes_of))
        themes = stream_lifecycle.read_theme_stream(spark, out)
        run_to_end(stream_lifecycle.lifecycle_stream(themes, out, f"{log}-events"))
    found = stream_lifecycle.read_events(spark, out).drop("batch_id")
    assert {tuple(r) for r in found.collect()} == expected
    assert {r.event_type for r in found.collect()} == {"created", "deactivated", "reactivated"}
    last = stream_lifecycle.read_state(spark, out)
    assert sorted(last.collect()) == sorted(state.select(*last.columns).collect())


def random_batches(make_posts, seed, n):
    """Batches of posts of few tags, some hours apart, some of one instant or older than the one before."""
    dice, batches, minutes = random.Random(seed), [], 40_000
    for number in range(n):
        minutes -= dice.choice([0, 60, 600, 3000])
        rows = [
            {"id": f"{number % 3}-{k}", "cashtags": [dice.choice("ABCDE")], "minutes_ago": minutes + dice.choice([0, 0, 30, 4000]),
             "likes": dice.choice([0, 0, 9])}
            for k in range(dice.randrange(1, 4))
        ]
        batches.append(make_posts(*rows))
    return batches


def by_tag(posts):
    """Themes whose id stays while their members change."""
    found = themes_of(posts)
    return found.withColumn("id", F.element_at("cashtags", 1))


@pytest.mark.parametrize("seed", [2])
def test_random_lifecycles_equal_the_replay(spark, make_posts, tmp_path, seed):
    landing, out, log = (str(tmp_path / name) for name in ("landing", "out", "log"))
    state, expected, clock, written = lifecycle.empty_state(spark), [], None, 0
    for posts in random_batches(make_posts, seed, 6):
        newest = posts.agg(F.max(F.unix_micros("created_at"))).first()[0]
        clock = newest if clock is None else max(newest, clock + 1000)
        batch = by_tag(posts)
        merged = lifecycle.reconcile(state, batch, F.timestamp_micros(F.lit(clock)), 48)
        rows = spark.createDataFrame(merged.rows.collect(), merged.rows.schema)
        state = lifecycle.Reconciled(rows).state
        expected += [tuple(r) for r in lifecycle.Reconciled(rows).log.collect()]
        written += rows.filter("event is not null").count()
        posts.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schemas.POSTS).parquet(landing)
        run_to_end(stream_lifecycle.theme_stream(stream, out, f"{log}-themes", by_tag))
        run_to_end(stream_lifecycle.lifecycle_stream(stream_lifecycle.read_theme_stream(spark, out), out, f"{log}-events"))
    found = stream_lifecycle.read_events(spark, out).drop("batch_id").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    last = stream_lifecycle.read_state(spark, out)
    assert sorted(last.collect()) == sorted(state.select(*last.columns).collect())
    # Only touched themes are written.
    assert stream_lifecycle.read_touched(spark, out).count() == written


def test_a_batch_of_themes_written_again_changes_nothing(spark, make_posts, tmp_path):
    landing, out, log = (str(tmp_path / name) for name in ("landing", "out", "log"))
    posts = make_posts({"id": "1", "cashtags": ["A"], "minutes_ago": 9})
    posts.write.parquet(landing)
    for again in (False, True):
        if again:
            stream_lifecycle.write_themes(posts, 0, out, by_tag)
        else:
            stream = spark.readStream.schema(schemas.POSTS).parquet(landing)
            run_to_end(stream_lifecycle.theme_stream(stream, out, f"{log}-themes", by_tag))
        run_to_end(stream_lifecycle.lifecycle_stream(stream_lifecycle.read_theme_stream(spark, out), out, f"{log}-events"))
    assert [r.event_type for r in stream_lifecycle.read_events(spark, out).collect()] == ["created"]


def test_windows_equal_the_velocity_at_their_end(spark, make_posts):
    posts = make_posts(
        *[{"id": str(i), "cashtags": ["BTC"], "minutes_ago": 61 * i + 1, "likes": 40 * i} for i in range(12)]
    )
    windows = velocity.windowed_velocity(velocity.keyed(posts), 6)
    end = windows.filter(F.col("window_end") == F.lit(NOW)).first()
    narratives = spark.createDataFrame([("n",)], "id string")
    members = posts.select(F.lit("n").alias("narrative_id"), F.col("id").alias("post_id"))
    batch = scoring.velocity(narratives, members, posts, NOW, 6).first()
    assert (end.posts, end.velocity_score) == (6, batch.velocity_score)


def test_window_edges(spark, make_posts):
    """A window holds its end and not its start, as the velocity at a clock does."""
    posts = make_posts({"id": "a", "cashtags": ["BTC"], "minutes_ago": 0}, {"id": "b", "cashtags": ["BTC"], "minutes_ago": 360})
    windows = velocity.windowed_velocity(velocity.keyed(posts), 6)
    themes = spark.createDataFrame([("n",)], "id string")
    members = posts.select(F.lit("n").alias("narrative_id"), F.col("id").alias("post_id"))
    for clock in (NOW, NOW - timedelta(hours=6), NOW - timedelta(hours=3)):
        seen = posts.filter(F.col("created_at") <= F.lit(clock))
        window = windows.filter(F.col("window_end") == F.lit(clock)).first()
        at_clock = scoring.velocity(themes, members, seen, clock, 6).first()
        assert (window.posts, window.velocity_score) == (1, at_clock.velocity_score)


def test_late_rows(spark, make_posts, tmp_path):
    """A row within the delay is counted, an older one is not."""
    landing, out, log = (str(tmp_path / name) for name in ("landing", "out", "log"))
    batches = [
        make_posts({"id": "a", "cashtags": ["X"], "minutes_ago": 600}),
        make_posts({"id": "late", "cashtags": ["X"], "minutes_ago": 650}, {"id": "b", "cashtags": ["X"], "minutes_ago": 590}),
        make_posts({"id": "too late", "cashtags": ["X"], "minutes_ago": 900}),
        make_posts({"id": "end", "cashtags": ["Y"], "minutes_ago": -9000}),
    ]
    dropped = 0
    for posts in batches:
        posts.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schemas.POSTS).parquet(landing)
        found = velocity.windowed_velocity(velocity.keyed(stream), 6, 6, "1 hour")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    rows = spark.read.schema(found.schema).parquet(out).filter("key = 'tag:X'").collect()
    assert sum(r.posts for r in rows) == 3 and dropped >= 1


