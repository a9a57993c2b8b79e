import random
import re

import pytest

from themeflow.constants import NEGATIONS
from themeflow.operators import cluster, sentiment
from themeflow.operators.sentiment import Lexicon
from themeflow.schemas import MEMBERSHIP

TEXTS = {
    "Surge and uptrend bring record gain and growth": (1.0, 5, 0, "bullish"),
    "Lawsuit and fraud fear over the plunge": (-1.0, 0, 4, "bearish"),
    "never resilient, only a slump ahead": (-0.6667, 0, 2, "bearish"),
    "higher-for-longer": (0.3333, 1, 0, "bullish"),
    "not a buy": (-0.3333, 0, 1, "bearish"),
    "isn't bullish": (0.3333, 1, 0, "bullish"),
    "buy sell": (0.0, 1, 1, "neutral"),
    "": (0.0, 0, 0, "neutral"),
}


def test_scores(spark, make_posts):
    posts = make_posts(*[{"id": text, "text": text} for text in TEXTS])
    rows = sentiment.score_posts(posts).collect()
    assert {r.id: (r.score, r.positive_hits, r.negative_hits, r.label) for r in rows} == TEXTS


@pytest.mark.parametrize("seed", range(2))
def test_hits_match_a_loop(spark, make_posts, seed):
    rng = random.Random(seed)
    words = ["up", "Up", "down", "flat", "not", "no", "x", "dont", "don't", "both"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(80)]
    lexicon = Lexicon(("up", "both"), ("down", "both"))

    def loop(text):
        hits, previous = {1: 0, -1: 0}, ""
        for token in (t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9_]{1,}", text)):
            sign = 1 if token in lexicon.positive else -1 if token in lexicon.negative else 0
            if sign:
                hits[-sign if previous in NEGATIONS else sign] += 1
            previous = token
        return hits[1], hits[-1]

    posts = make_posts(*[{"id": str(i), "text": text} for i, text in enumerate(texts)])
    rows = sentiment.score_posts(posts, lexicon).collect()
    assert {int(r.id): (r.positive_hits, r.negative_hits) for r in rows} == dict(enumerate(map(loop, texts)))


def big_table(spark):
    """Sixty thousand words, among them those of the texts; a few of both signs."""
    rows = spark.range(60_000).selectExpr("concat('word', id) AS word", "if(id % 3 = 0, 1, -1) AS polarity")
    own = [("UP", 1), ("both", 1), ("down", -7), ("both", -1), (None, 1), ("flat", 0)]
    return rows.unionByName(spark.createDataFrame(own, "word string, polarity int"))


@pytest.mark.parametrize("limit", [0, sentiment.BROADCAST_BYTES])
def test_a_table_of_any_size(spark, make_posts, limit):
    """A table broadcast or shuffled gives what the same words give as lists."""
    rng = random.Random(9)
    words = ["up", "Up", "down", "flat", "not", "no", "x", "dont", "both", "word3", "word4", "Word59999", "word60000"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(60)] + ["", "not"]
    posts = make_posts(*[{"id": str(i), "text": text, "likes": i, "cashtags": ["A"]} for i, text in enumerate(texts)])
    table = sentiment.lexicon_table(big_table(spark), limit)
    assert table.words.count() == 60_003 and table.small == bool(limit)
    lists = Lexicon(("up", "both", "word3"), ("down", "word4", "word59999"))
    assert sorted(sentiment.score_posts(posts, table).collect()) == sorted(sentiment.score_posts(posts, lists).collect())
    assert sorted(sentiment.top_terms(posts, 5, table).collect()) == sorted(sentiment.top_terms(posts, 5, lists).collect())
    one, other = (sorted(cluster.assign(posts, x).collect()) for x in (table, lists))
    assert one == other
    narratives, members = themes(spark, a=["1", "2", "2", "missing"])
    found = [sentiment.theme_sentiment(narratives, members, posts, x).collect() for x in (table, lists)]
    assert found[0] == found[1]


def test_a_side_without_words_has_the_default_ones(spark, make_posts):
    posts = make_posts({"id": "1", "text": "zip rally zip crash"})
    row = sentiment.score_posts(posts, sentiment.lexicon_table(spark.createDataFrame([("zip", 1)], "word string, polarity int"))).first()
    assert (row.positive_hits, row.negative_hits) == (2, 1)
    none = sentiment.lexicon_table(spark.createDataFrame([], "word string, polarity int"))
    row = sentiment.score_posts(posts, none).first()
    assert (row.positive_hits, row.negative_hits) == (1, 1)


def test_an_empty_list_means_the_default(spark, make_posts):
    posts = make_posts({"id": "1", "text": "zip rally zip crash"})
    row = sentiment.score_posts(posts, Lexicon(positive=("zip",), negative=())).first()
    assert (row.positive_hits, row.negative_hits) == (2, 1)


def themes(spark, **members):
    narratives = spark.createDataFrame(
        [(name, 0.4, 0.2) for name in members], "id string, velocity_score double, saturation_score double"
    )
    rows = [(name, post_id) for name, ids in members.items() for post_id in ids]
    return narratives, spark.createDataFrame(rows, MEMBERSHIP)


def test_theme_sentiment_weighs_engagement(spark, make_posts):
    posts = make_posts(
        {"id": "1", "text": "Surge with record support and gain", "likes": 300, "replies": -50},
        {"id": "2", "text": "fraud and lawsuit bring a plunge"},
    )
    narratives, members = themes(spark, a=["1", "2", "missing"], twice=["1", "1", "2"], none=["missing"])
    rows = sentiment.theme_sentiment(narratives, members, posts).collect()
    assert {r.narrative_id: (r.score, r.label, r.sample_size) for r in rows} == {
        "a": (0.5, "bullish", 2),
        "twice": (round((3 + 3 - 1) / 7, 4), "bullish", 3),
        "none": (0.0, "neutral", 0),
    }


def test_overall_score(spark, make_posts):
    posts = make_posts({"id": "1", "text": "bullish rally"}, {"id": "2", "text": "bullish breakout"})
    narratives, members = themes(spark, n=["1", "2"])
    row = sentiment.apply_sentiment(narratives, members, posts).first()
    assert (row.sentiment_score, row.overall_score) == (0.6667, 0.4567)


def test_top_terms_rank_by_count_then_first_met(spark, make_posts):
    posts = make_posts(
        {"id": "1", "text": "gain rally not rally"}, {"id": "2", "text": "crash rally pump", "minutes_ago": 5}
    )
    rows = sentiment.top_terms(posts, 2).orderBy("side", "rank").collect()
    assert [(r.side, r.token, r.n) for r in rows] == [
        ("negative", "rally", 1), ("negative", "crash", 1), ("positive", "rally", 2), ("positive", "gain", 1),
    ]


def test_weight(spark, make_posts):
    posts = make_posts({"id": "1", "likes": 120, "replies": -9, "reposts": 3}, {"id": "2", "likes": 999})
    rows = posts.select("id", sentiment.engagement_weight().alias("w")).orderBy("id").collect()
    assert [r.w for r in rows] == [pytest.approx(1.23), 2.0]
