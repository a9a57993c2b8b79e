import pytest

from themeflow.functions.core import distinct_up_to
from themeflow.operators import cluster, scoring, sentiment
from themeflow.operators.staging import stage
from themeflow.plans import runs
from themeflow.schemas import MEMBERSHIP
from tests.conftest import NOW
from tests.test_cluster import random_posts


@pytest.fixture
def case(spark, make_posts):
    posts = make_posts(*[
        {"id": f"post_{i}", "author": f"user_{i % 5}", "minutes_ago": 60 * i, "likes": 100 * i,
         "replies": 10 * i, "reposts": 5 * i}
        for i in range(10)
    ])
    narratives = spark.createDataFrame([("narr_1",), ("gone",)], "id string")
    members = spark.createDataFrame(
        [("narr_1", f"post_{i}") for i in range(5)] + [("gone", "nowhere")], MEMBERSHIP
    )
    return narratives, members, posts


def test_velocity(case):
    rows = scoring.velocity(*case, NOW).collect()
    assert {r.id: r.velocity_score for r in rows} == {"narr_1": 0.1965, "gone": 0.0}


def test_the_window_excludes_its_start(case):
    rows = scoring.velocity(*case, NOW, 4).collect()
    # Posts 0 to 3 are inside: 4 / 4 per hour, 690 / 4 engagement per post.
    assert {r.id: r.velocity_score for r in rows}["narr_1"] == round(0.6 * 0.1 + 0.4 * (172.5 / 500), 4)


def test_saturation(case):
    rows = scoring.saturation(*case).collect()
    assert {r.id: r.saturation_score for r in rows} == {"narr_1": 0.73, "gone": 0.7}


def test_no_posts(case):
    narratives, members, posts = case
    empty = posts.filter("false")
    assert {r.saturation_score for r in scoring.saturation(narratives, members, empty).collect()} == {0.0}
    assert {r.velocity_score for r in scoring.velocity(narratives, members, empty, NOW).collect()} == {0.0}


def test_both_at_once(case):
    rows = {r.id: (r.velocity_score, r.saturation_score) for r in scoring.update_scores(*case, NOW).collect()}
    assert rows == {"narr_1": (0.1965, 0.73), "gone": (0.0, 0.7)}


def test_window_must_be_positive(case):
    with pytest.raises(ValueError):
        scoring.velocity(*case, NOW, 0)


def test_aggregates_by_key_equal_the_joins(make_posts):
    posts = make_posts(*random_posts(11))
    found = runs.analyse(posts, NOW, hours=1)
    clusters, members = stage(found.clusters, "clusters"), stage(found.membership, "members")
    themes = cluster.as_narratives(clusters)
    scored = scoring.update_scores(themes, members, posts, NOW, 1)
    joined = sentiment.apply_sentiment(scored, members, posts)
    names = ("id", "sentiment_score", "velocity_score", "saturation_score", "overall_score")
    assert sorted(joined.select(*names).collect()) == sorted(clusters.select(*names).collect())


def test_distinct_values_saturate(spark):
    rows = [(k, f"a{i % k}") for k in (1, 2, 49, 50, 51, 63, 64, 128, 129, 300, 5000) for i in range(2 * k)]
    rows += [(0, None), (7, ""), (7, None), (7, "b")]
    df = spark.createDataFrame(rows, "k int, author string").repartition(5)
    found = {r.k: r.n for r in df.groupBy("k").agg(distinct_up_to("author", 50).alias("n")).collect()}
    assert found == {k: min(k, 50) for k in (0, 1, 2, 49, 50, 51, 63, 64, 128, 129, 300, 5000)} | {7: 2}
    for most in (1, 3, 1000):
        found = {r.k: r.n for r in df.groupBy("k").agg(distinct_up_to("author", most).alias("n")).collect()}
        assert found[5000] == most and found[2] == min(2, most) and found[300] == min(300, most)
