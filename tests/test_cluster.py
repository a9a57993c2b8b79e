import hashlib
import random
import re
from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from themeflow.constants import STOPWORDS
from themeflow.operators import cluster, reports
from themeflow.plans import runs
from tests.conftest import NOW


def clusters(posts, **kwargs):
    return cluster.cluster(posts, cluster.assign(posts), **kwargs)


def test_groups_by_tag_set(make_posts):
    posts = make_posts(
        {"id": "oats", "text": "rain again", "cashtags": ["WHT"]},
        {"id": "rye", "text": "two silos left", "cashtags": ["wht", ""]},
        {"id": "hops", "text": "mills closed", "cashtags": ["CRN"]},
        {"id": "malt", "text": "spread", "cashtags": ["CRN", "WHT"]},
    )
    row = clusters(posts).collect()
    assert len(row) == 1
    assert row[0].key == "tag:WHT" and row[0].cashtags == ["WHT"] and row[0].n_posts == 2
    assert row[0].confidence == 0.65
    assert row[0].id == theme_id(["oats", "rye"])
    assert row[0].name == "$WHT narrative momentum"
    assert {r.key for r in cluster.group_keys(posts).collect()} == {"tag:WHT", "tag:CRN", "tag:CRN+WHT"}


def test_groups_by_keyword_and_names_the_theme(make_posts):
    posts = make_posts(
        {"id": "k", "text": "Barley yields climb sharply"},
        {"id": "l", "text": "Barley harvest delayed", "platform": "news", "minutes_ago": 1},
        {"id": "m", "text": "Quiet ferries"},
        {"id": "n", "text": "7 b"},
        {"id": "o", "text": "", "minutes_ago": 3},
    )
    rows = {r.key: r for r in clusters(posts).collect()}
    assert set(rows) == {"kw:barley", "kw:misc"}
    barley = rows["kw:barley"]
    assert barley.name == "Barley discussion cluster"
    assert barley.description == "Cluster of 2 posts across news, twitter focused on barley, yields, climb, sharply."
    assert barley.keywords == ["barley", "yields", "climb", "sharply", "harvest", "delayed"]
    assert rows["kw:misc"].name == "Market discussion cluster"
    assert rows["kw:misc"].description.endswith("focused on broad market chatter.")


def test_time_bounds(make_posts):
    posts = make_posts(
        {"id": "x", "cashtags": ["SOL"], "minutes_ago": 120}, {"id": "y", "cashtags": ["SOL"], "minutes_ago": 30}
    )
    row = clusters(posts, now=NOW).first()
    assert (row.first_seen, row.last_seen) == ((NOW - timedelta(hours=2)).replace(tzinfo=None), NOW.replace(tzinfo=None))
    assert clusters(posts).first().last_seen == (NOW - timedelta(minutes=30)).replace(tzinfo=None)


def theme_id(ids):
    digests = [hashlib.sha1(i.encode()).hexdigest() for i in ids]
    sums = [sum(int(d[i : i + 10], 16) for d in digests) for i in range(0, 40, 10)]
    return "nar_" + hashlib.sha1("|".join(map(str, [len(ids), *sums])).encode()).hexdigest()[:12]


def loop_over(posts):
    """Themes by plain loops, newest post first."""
    def words(p):
        return [w for w in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", p["text"].lower()) if w not in STOPWORDS]

    groups = defaultdict(list)
    for p in sorted(posts, key=lambda p: p["minutes_ago"]):
        tags = sorted({t.upper() for t in p["cashtags"] if t})
        top = Counter(words(p)).most_common(1)
        groups["tag:" + "+".join(tags) if tags else "kw:" + (top[0][0] if top else "misc")].append(p)
    found = {}
    for key, members in groups.items():
        if len(members) < 2:
            continue
        word_counts = Counter(w for p in members for w in words(p))
        tag_counts = Counter(t.upper() for p in members for t in p["cashtags"] if t)
        found[key] = (
            theme_id([p["id"] for p in members]),
            [w for w, _ in word_counts.most_common(8)],
            [t for t, _ in tag_counts.most_common(5)],
            len({p["author"] for p in members}),
        )
    return found


def random_posts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(25)] + ["with", "ok"]
    return [
        {
            "id": f"p{i}",
            "text": " ".join(rng.choices(vocabulary, k=rng.randrange(12))),
            "cashtags": rng.choices(["btc", "BTC", "eth", ""], k=rng.choice([0, 0, 1, 3])),
            "minutes_ago": i,
            "author": f"u{rng.randrange(20)}",
            "platform": rng.choice(["twitter", "news"]),
            "likes": rng.randrange(-5, 300),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_matches_plain_loops(make_posts, seed):
    posts = random_posts(seed)
    rows = clusters(make_posts(*posts)).collect()
    assert {r.key: (r.id, r.keywords, r.cashtags, r.authors) for r in rows} == loop_over(posts)


def test_membership_and_order(make_posts):
    posts = make_posts(*random_posts(7))
    found = runs.analyse(posts, NOW)
    counts = {r.narrative_id: r["count"] for r in found.membership.groupBy("narrative_id").count().collect()}
    ranked = cluster.ranked(found.clusters).collect()
    assert counts == {r.id: r.n_posts for r in ranked}
    order = [(r.confidence, r.n_posts) for r in ranked]
    assert order == sorted(order, reverse=True)


def test_ids_and_documents_do_not_depend_on_layout(spark, make_posts):
    posts = make_posts(*random_posts(3))
    assigned = cluster.assign(posts)
    found = cluster.cluster(posts, assigned)
    ids = {r.key: r.id for r in found.collect()}
    sizes = {r.id: r.n_posts for r in found.collect()}
    for partitions in (1, 7):
        again = cluster.cluster(posts.repartition(partitions), assigned.repartition(partitions))
        assert {r.key: r.id for r in again.collect()} == ids
    documents = reports.narrative_documents(
        cluster.as_narratives(found), cluster.membership(assigned, found)
    )
    counts = {(r.id, r.kind): r["count"] for r in documents.groupBy("id", "kind").count().collect()}
    assert counts == {(i, "theme"): 1 for i in sizes} | {(i, "member"): n for i, n in sizes.items()}


def test_a_member_changes_the_id(make_posts):
    posts = [{"id": f"p{i}", "cashtags": ["btc"]} for i in range(5)]
    first, = clusters(make_posts(*posts)).collect()
    other, = clusters(make_posts(*posts[:-1], {"id": "q", "cashtags": ["btc"]})).collect()
    fewer, = clusters(make_posts(*posts[:-1])).collect()
    assert len({first.id, other.id, fewer.id}) == 3


def test_rank(make_posts):
    posts = make_posts(*random_posts(9, 200))
    found = clusters(posts)
    order = [r.id for r in cluster.ranked(found).collect()]
    rows = sorted(cluster.with_rank(found, 3).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(order) + 1))
    assert [r.id for r in rows] == order


def test_the_labeler_runs_in_several_tasks(make_posts):
    posts = make_posts(*[{"id": f"p{i}", "cashtags": [f"t{i % 20}"], "text": "some text"} for i in range(60)])
    found = clusters(posts)

    def labeler(texts, keywords, cashtags):
        from pyspark import TaskContext

        return {"name": str(TaskContext.get().partitionId()), "description": "d", "keywords": keywords}

    rows = cluster.apply_labeler(found, cluster.sample_texts(posts, 2), labeler, 6).collect()
    assert len(rows) == 20 and len({r.name for r in rows}) > 1


def test_labeler_failures_fall_back(make_posts):
    posts = make_posts(
        {"id": "1", "cashtags": ["BTC"], "text": "first btc"}, {"id": "2", "cashtags": ["BTC"], "text": "second", "minutes_ago": 1},
        {"id": "3", "text": "etf flows"}, {"id": "4", "text": "etf news"},
    )

    def labeler(texts, keywords, cashtags):
        return {"name": f"{cashtags[0]}: {texts[0]}", "description": "d", "keywords": keywords[:1]}

    named = cluster.apply_labeler(clusters(posts), cluster.sample_texts(posts, 3), labeler, 2)
    rows = {r.key: (r.name, r.description, r.keywords, r.cashtags) for r in named.collect()}
    assert rows["tag:BTC"] == ("BTC: first btc", "d", ["first"], ["BTC"])
    assert rows["kw:etf"][0] == "Etf discussion cluster"


def test_a_labeler_sees_every_text_of_a_large_theme(make_posts):
    """A theme with a third of all posts and more is labelled by several tasks, a few texts per call."""
    posts = make_posts(
        *[{"id": f"hot{i}", "cashtags": ["HOT"], "text": f"hot text{i}", "minutes_ago": i} for i in range(120)],
        *[{"id": f"p{i}", "cashtags": [f"t{i % 5}"], "text": f"small text{i}"} for i in range(60)],
    )
    found = clusters(posts)

    def labeler(texts, keywords, cashtags):
        from pyspark import TaskContext

        assert len(texts) <= 8
        numbers = [int(t.split("text")[1]) for t in texts]
        if cashtags == ["HOT"]:
            assert numbers == sorted(numbers)  # newest first
        return {"name": str(TaskContext.get().partitionId()), "description": " ".join(texts), "keywords": cashtags}

    def merger(drafts, keywords, cashtags):
        assert 2 <= len(drafts) <= 3
        tasks = sorted({t for d in drafts for t in d["name"].split()})
        return {"name": " ".join(tasks), "description": " ".join(d["description"] for d in drafts), "keywords": drafts[0]["keywords"]}

    rows = {r.key: r for r in cluster.label_all_texts(found, posts, labeler, merger, 6, 8, 3).collect()}
    assert len(rows) == found.count() == 6
    hot = rows["tag:HOT"]
    assert sorted(hot.description.split()) == sorted(x for i in range(120) for x in ("hot", f"text{i}"))
    assert len(hot.name.split()) > 1 and hot.keywords == ["HOT"]
    assert sum(r.description.count("text") for r in rows.values()) == 180


def test_drafts_are_read_by_the_labeler_itself(make_posts):
    posts = make_posts(*[{"id": str(i), "cashtags": ["A"], "text": f"one{i}"} for i in range(30)])

    def labeler(texts, keywords, cashtags):
        return {"name": "n", "description": str(sum(1 if t.startswith("one") else int(t.split(". ")[1]) for t in texts)), "keywords": []}

    row = cluster.label_all_texts(clusters(posts), posts, labeler, texts_per_call=4, drafts_per_call=2).first()
    assert (row.name, row.description) == ("n", "30")


def test_themes_whose_calls_fail_keep_their_wording(make_posts):
    posts = make_posts(*[{"id": str(i), "cashtags": ["A"], "text": "etf"} for i in range(4)], *[{"id": f"x{i}", "text": "etf"} for i in range(4)])
    found = clusters(posts)

    def labeler(texts, keywords, cashtags):
        return {"name": cashtags[0], "description": "d", "keywords": keywords}

    names = {r.key: r.name for r in cluster.label_all_texts(found, posts, labeler).collect()}
    assert names == {"tag:A": "A", "kw:etf": "Etf discussion cluster"}
    with pytest.raises(ValueError):
        cluster.label_all_texts(found, posts, labeler, drafts_per_call=1)


@pytest.mark.parametrize("tracked, candidates", [(cluster.TRACKED, cluster.CANDIDATES), (200, 20), (16, 8)])
def test_summaries_give_the_same_keywords(make_posts, tracked, candidates):
    """With room for all words, with too little for some groups, and with far too little for any."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(1500)]
    weights = [1 / (i + 1) for i in range(1500)]
    rows = [{"id": f"a{i}", "cashtags": ["A"], "text": " ".join(rng.choices(words, weights, k=60)), "minutes_ago": i} for i in range(60)]
    rows += [{"id": f"b{i}", "cashtags": ["B"], "text": " ".join(rng.sample(words, 20)), "minutes_ago": i} for i in range(50)]
    rows += [{"id": f"c{i}", "cashtags": ["C"], "text": "same four words only" if i else ""} for i in range(3)]
    rows += [{"id": "d", "cashtags": ["D"], "text": ""}]
    posts = make_posts(*rows)
    keys = cluster.group_keys(posts).select("key").distinct()
    found = cluster.top_keywords_of_large(posts, keys, 8, tracked, candidates)
    assert sorted(found.collect()) == sorted(cluster.top_keywords(posts, 8).collect())


def test_a_summary_leaves_one_row_per_group_and_task(make_posts):
    posts = make_posts(*random_posts(1, 40)).repartition(3)
    rows = cluster._keyword_rows(posts, None)
    from pyspark.sql import functions as F

    text = rows.groupBy("key").agg(F.expr("approx_top_k_accumulate(item, 100)").alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_approx_top_k_accumulate" in text and "hashpartitioning(key" in text


def test_only_the_largest_groups_are_summarised(make_posts, monkeypatch):
    # Beyond some groups Spark sorts every word for their summaries, so the others are counted in full at once.
    rows = [{"id": f"{k}-{i}", "cashtags": [k], "text": f"alpha beta{i % 3} gamma{i}"} for n, k in enumerate("ABCDE") for i in range(3 + n)]
    posts = make_posts(*rows)
    keys = cluster.group_keys(posts).select("key").distinct()
    staged = {}

    def stage(df, name, keep=cluster.stage):
        staged[name] = keep(df, name)
        return staged[name]

    monkeypatch.setattr(cluster, "stage", stage)
    expected = sorted(cluster.top_keywords(posts, 2).collect())
    for summarised, per_tracked, chosen in ((2, 0, ["tag:D", "tag:E"]), (9, 1, ["tag:D", "tag:E"]), (9, 0, [f"tag:{k}" for k in "ABCDE"])):
        found = cluster.top_keywords_of_large(posts, keys, 2, 18, 4, summarised=summarised, words_per_tracked=per_tracked)
        assert sorted(r.key for r in staged["summarised-groups"].collect()) == chosen
        assert sorted(found.collect()) == expected


def test_a_task_holds_the_texts_of_one_call(make_posts, monkeypatch):
    # A data frame per chunk cost more than the texts: chunks are read one after the other from a sorted task.
    posts = make_posts(*[{"id": str(i), "cashtags": ["A"], "text": f"one{i}"} for i in range(40)])
    plans = []

    def stage(df, name, keep=cluster.stage):
        if name == "drafts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(cluster, "stage", stage)
    labeler = lambda texts, keywords, cashtags: {"name": "n", "description": str(len(texts)), "keywords": []}
    merger = lambda drafts, keywords, cashtags: {"name": "n", "description": str(sum(int(d["description"]) for d in drafts)), "keywords": []}
    assert cluster.label_all_texts(clusters(posts), posts, labeler, merger, 3, 4, 2).first().description == "40"
    assert plans and all("MapInArrow" in p and "CoGroups" not in p for p in plans)


def test_ids_of_themes_need_no_words(make_posts):
    posts = make_posts(*random_posts(3, 60))
    assigned = cluster.assign(posts)
    found = cluster.cluster(posts, assigned)
    assert sorted(cluster.theme_profiles(assigned).select("id", "key").collect()) == sorted(found.select("id", "key").collect())
