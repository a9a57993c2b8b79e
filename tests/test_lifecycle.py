from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from themeflow.operators import lifecycle, reports
from themeflow.operators.staging import stage
from themeflow.plans import runs
from tests.test_cluster import random_posts

START = datetime(2026, 3, 10, 12, tzinfo=timezone.utc)


def batch(spark, now, *themes):
    rows = [
        (id, name, f"{name} description", now - timedelta(hours=2), now, list(ids), ["BTC"], ["flows", "etf"],
         0.4, 0.5, 0.3, score, True, 0.72)
        for id, name, ids, score in themes
    ]
    schema = (
        "id string, name string, description string, first_seen timestamp, last_seen timestamp, "
        "post_ids array<string>, cashtags array<string>, keywords array<string>, sentiment_score double, "
        "velocity_score double, saturation_score double, overall_score double, is_active boolean, confidence double"
    )
    return lifecycle.from_post_lists(spark.createDataFrame(rows, schema))[0]


def run(spark, state, now, *themes, stale=48):
    merged = lifecycle.reconcile(state, batch(spark, now, *themes), now, stale)
    return lifecycle.Reconciled(stage(merged.rows, "merged"))


def events(merged):
    return {r.narrative_id: (r.event, r.previous_version, r.new_version) for r in merged.events.collect()}


def test_all_events(spark):
    state = lifecycle.empty_state(spark)
    first = run(spark, state, START, ("n1", "BTC", ["p1", "p2"], 0.47), ("n2", "ETH", ["a"], 0.5))
    assert events(first) == {"n1": ("created", 0, 1), "n2": ("created", 0, 1)}
    assert {r.details for r in first.log.collect()} == {'{"name":"BTC"}', '{"name":"ETH"}'}

    # Order of members and times do not matter.
    later = START + timedelta(minutes=20)
    same = run(spark, first.state, later, ("n1", "BTC", ["p2", "p1"], 0.47 + 1e-7))
    assert events(same) == {"n1": ("unchanged", 1, 1)}
    assert same.log.count() == 0
    assert same.state.filter("id = 'n1'").first().updated_at == later.replace(tzinfo=None)

    grown = run(spark, same.state, later, ("n1", "BTC", ["p1", "p2", "p3"], 0.47))
    assert events(grown) == {"n1": ("updated", 1, 2)}

    stale = run(spark, grown.state, START + timedelta(hours=50), stale=24)
    assert events(stale) == {"n1": ("deactivated", 2, 3), "n2": ("deactivated", 1, 2)}
    assert lifecycle.active_themes(stale.state).count() == 0
    assert {(r.event_type, r.details) for r in stale.log.collect()} == {("deactivated", "{}")}
    assert events(run(spark, stale.state, START + timedelta(hours=60), stale=24)) == {}

    back = run(spark, stale.state, START + timedelta(hours=73), ("n2", "ETH", ["a"], 0.5))
    assert events(back) == {"n2": ("reactivated", 2, 3)}
    assert [(r.id, r.version) for r in lifecycle.active_themes(back.state).collect()] == [("n2", 3)]
    summary = reports.event_summary(stale.events)
    assert [tuple(r) for r in summary.collect()] == [("deactivated", 2)]


@pytest.mark.parametrize(
    "theme", [("n", "other", ["p"], 0.4), ("n", "x", ["q"], 0.4), ("n", "x", ["p"], 0.41)]
)
def test_material_changes(spark, theme):
    state = run(spark, lifecycle.empty_state(spark), START, ("n", "x", ["p"], 0.4)).state
    assert events(run(spark, state, START, theme)) == {"n": ("updated", 1, 2)}


def test_state_keeps_arrays_sorted_and_active_order(spark):
    merged = run(spark, lifecycle.empty_state(spark), START, ("a", "x", ["p"], 0.1), ("b", "x", ["q"], 0.9))
    rows = lifecycle.active_themes(merged.state).collect()
    assert [r.id for r in rows] == ["b", "a"]
    assert rows[0].keywords == ["etf", "flows"]


def test_a_theme_seen_again_is_active_whatever_its_flag(spark):
    found = batch(spark, START, ("n", "x", ["p"], 0.4)).withColumn("is_active", F.lit(False))
    merged = lifecycle.reconcile(lifecycle.empty_state(spark), found, START)
    assert not merged.state.first().is_active
    again = lifecycle.reconcile(merged.state, found, START)
    assert events(again) == {"n": ("reactivated", 1, 2)}
    assert again.state.first().is_active


def test_stale_themes(spark):
    state = run(spark, lifecycle.empty_state(spark), START, ("a", "x", ["p"], 0.1), ("b", "x", ["q"], 0.9)).state
    seen = batch(spark, START, ("a", "x", ["p"], 0.1))
    late = START + timedelta(hours=49)
    assert [r.id for r in lifecycle.stale_themes(state, seen, late).collect()] == ["b"]
    assert lifecycle.stale_themes(state, seen, START + timedelta(hours=48)).count() == 0


def test_repeated_ids_fail(spark):
    twice = batch(spark, START, ("a", "x", ["p"], 0.1), ("a", "x", ["p"], 0.1))
    with pytest.raises(ValueError):
        lifecycle.assert_unique(twice)


def test_large_member_lists(spark):
    ids = [f"p{i}" for i in range(95)]
    rows = [("n", ids), ("m", ids[::-1]), ("o", ids[:5])]
    narratives = spark.createDataFrame(rows, "id string, post_ids array<string>").select(
        "id", "post_ids", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lifecycle.NARRATIVES
                            if f.name not in ("id", "n_posts", "members_digest")]
    )
    themes, members = lifecycle.from_post_lists(narratives)
    found = {r.id: r.members_digest for r in themes.collect()}
    assert found["n"] == found["m"] != found["o"]
    assert members.count() == 195


def test_repeated_ids_fail_in_the_merge(spark):
    twice = batch(spark, START, ("a", "x", ["p"], 0.1), ("a", "x", ["p"], 0.1))
    merged = lifecycle.reconcile(lifecycle.empty_state(spark), twice, START)
    with pytest.raises(Exception, match="occurs more than once"):
        merged.rows.collect()


def test_a_tracking_run(spark, make_posts):
    posts = make_posts(*random_posts(5))
    merged, members, done = runs.track(posts, lifecycle.empty_state(spark), START)
    kinds = {r.event for r in merged.events.collect()}
    assert kinds == {"created"}
    assert members.select("narrative_id").distinct().count() == merged.state.count()
    assert done.count() == posts.count()
    again, _, _ = runs.track(posts, merged.state, START)
    assert {r.event for r in again.events.collect()} == {"unchanged"}
