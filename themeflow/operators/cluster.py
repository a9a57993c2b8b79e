"""Grouping of posts into themes by ticker tags or dominant keyword.

``assign`` reads each text once and leaves one narrow row per post.  Everything about a theme, its
id included, is then a partial aggregate by group key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from themeflow.constants import (
    FULL_AUTHORS, KEYWORD_LIMIT, MAX_CASHTAGS, MAX_KEYWORDS, MIN_CLUSTER_SIZE, THEME_DIGEST_CHARS,
)
from themeflow.functions.core import (
    distinct_up_to, engagement, exact_round, instant, order_in_post, post_order,
)
from themeflow.functions.text import dominant_word, keyword_tokens, title_case, upper_tags
from themeflow.operators.ranking import first_per_group
from themeflow.operators.sentiment import (
    DEFAULT_LEXICON, Lexicon, LexiconTable, score_units, scored, weight_units,
)
from themeflow.operators.members import LIMBS, limb_sums, members_digest
from themeflow.operators.staging import stage

#: Keys of kept groups are broadcast up to this many bytes.
BROADCAST_BYTES = 16 << 20


def group_key(words: Column | None = None) -> Column:
    """``tag:`` and the set of tags, or ``kw:`` and the dominant keyword of the text.

    ``words`` are the keyword tokens of the text where they are at hand already.
    """
    tags = F.sort_array(F.array_distinct(upper_tags("cashtags")))
    words = keyword_tokens("text") if words is None else words
    by_word = F.concat(F.lit("kw:"), F.coalesce(dominant_word(words), F.lit("misc")))
    return F.when(
        F.size(tags) > 0, F.concat(F.lit("tag:"), F.array_join(tags, "+"))
    ).otherwise(by_word)


def group_keys(posts: DataFrame) -> DataFrame:
    return posts.select("id", group_key().alias("key"))


def assign(posts: DataFrame, lexicon: Lexicon | LexiconTable = DEFAULT_LEXICON) -> DataFrame:
    """One narrow row per post with its group key, score and weights; the text stays behind.

    Several aggregates read this table, so ``stage`` it first when texts are large.
    """
    found = scored(
        posts,
        lexicon,
        group_key().alias("key"),
        "platform",
        "author_id",
        "created_at",
        engagement().alias("engagement"),
        weight_units().alias("weight"),
        upper_tags("cashtags").alias("tags"),
        post_order().alias("post_order"),
    )
    return found.select(
        "id", "key", "platform", "author_id", "created_at", "engagement", "weight",
        score_units(F.col("score")).alias("units"), "tags", "post_order",
    )


def _ranked_items(rows: DataFrame, limit: int) -> DataFrame:
    """Most frequent items per key, ties by first appearance: ``key, rank, item, n``.

    Input rows are ``key, post_order, position, item``.  Counting is by ``(key, item)``, so a
    large key is spread over its items; the rank filter is applied before the rows of one key
    meet, which leaves at most ``limit`` rows per key and task.
    """
    counted = rows.groupBy("key", "item").agg(
        F.count("*").alias("n"),
        F.min(order_in_post(F.col("post_order"), F.col("position"))).alias("first_met"),
    )
    ranked = first_per_group(counted, ["key"], [F.desc("n"), "first_met", "item"], limit, "item", "rank")
    return ranked.select("key", "rank", "item", "n")


def _keyword_tokens(posts: DataFrame, kept: DataFrame | None) -> DataFrame:
    """``key, post_order, tokens`` of each post; of the groups in ``kept`` only."""
    split = posts.select("id", "created_at", "cashtags", keyword_tokens("text").alias("tokens"))
    # Apart from the explode: columns selected next to it are evaluated once per exploded row.
    tokens = split.select(
        group_key(F.col("tokens")).alias("key"), post_order().alias("post_order"), "tokens"
    )
    return tokens if kept is None else tokens.join(F.broadcast(kept), "key", "left_semi")


def _word_rows(tokens: DataFrame) -> DataFrame:
    """``key, post_order, position, item`` of each word in ``tokens``."""
    # The outer form, because the inner one makes Spark filter on ``size(tokens) > 0`` at the
    # scan, which splits every text a second time.
    rows = tokens.select("key", "post_order", F.posexplode_outer("tokens").alias("position", "item"))
    return rows.filter(F.col("item").isNotNull())


def _keyword_rows(posts: DataFrame, kept: DataFrame | None) -> DataFrame:
    """``key, post_order, position, item`` of each keyword; of the groups in ``kept`` only."""
    return _word_rows(_keyword_tokens(posts, kept))


def top_keywords(
    posts: DataFrame, limit: int = MAX_KEYWORDS, kept: DataFrame | None = None
) -> DataFrame:
    """``key, rank, item, n`` from a second pass over the texts.

    With ``kept`` (a small table of keys, broadcast) words of other groups are never counted.
    """
    return _ranked_items(_keyword_rows(posts, kept), min(limit, KEYWORD_LIMIT))


#: Words that a summary tracks per group, and candidates that are counted again.
TRACKED, CANDIDATES = 12_000, 64
#: Groups that are summarised: few enough that a task keeps all their summaries (beyond 128 groups Spark
#: sorts and spills every word instead), each of many times the words that a summary tracks.
SUMMARISED, WORDS_PER_TRACKED = 100, 20


def top_keywords_of_large(
    posts: DataFrame, large: DataFrame, limit: int = MAX_KEYWORDS, tracked: int = TRACKED, candidates: int = CANDIDATES,
    summarised: int = SUMMARISED, words_per_tracked: int = WORDS_PER_TRACKED,
) -> DataFrame:
    """``top_keywords`` of the groups in ``large`` (column ``key``: few groups of many posts), by summaries.

    One pass keeps a summary of frequent items per group and task, of at most ``tracked`` words however
    many the group has; summaries merge.  A second pass counts the candidates exactly.  A word that is
    no candidate occurs at most as often as the last candidate's estimate or, where fewer were found,
    twice the summary's error, so a ranking whose last count is above that is proven.  Groups
    without proof are counted in full, so the result is that of ``top_keywords`` always.  So are, at once,
    groups of too few words to gain by a summary, and all but the ``summarised`` largest.  Texts are
    split once: the words of the groups are staged for the passes.
    """
    limit = min(limit, KEYWORD_LIMIT)
    if candidates < limit or tracked < candidates:
        raise ValueError("a summary tracks its candidates, of which there are as many as ranks")
    tokens = stage(_keyword_tokens(posts, large), "group-words")
    words = stage(tokens.groupBy("key").agg(F.sum(F.size("tokens").cast("long")).alias("words")), "group-sizes")
    worth = words.filter(F.col("words") >= tracked * words_per_tracked)
    worth = stage(worth.orderBy(F.desc("words"), "key").limit(summarised).select("key"), "summarised-groups")
    rows = _word_rows(tokens.join(F.broadcast(worth), "key", "left_semi"))
    summary = rows.groupBy("key").agg(
        F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("state"), F.count("*").alias("total")
    )
    listed = summary.select("key", "total", F.expr(f"approx_top_k_estimate(state, {candidates})").alias("found"))
    # The error is at most 3.5 / size of the total; the summary's size is tracked / 0.75 or more.
    error = F.col("total") * (2 * 3.5 * 0.75 / tracked)
    last = F.when(F.size("found") >= candidates, F.array_min(F.transform("found", lambda x: x["count"]))).otherwise(0)
    listed = stage(listed.select("key", F.col("found.item").alias("items"), F.greatest(error, last).alias("unlisted")), "frequent-words")
    pairs = listed.select("key", F.explode("items").alias("item"))  # candidates per group
    exact = stage(_ranked_items(rows.join(F.broadcast(pairs), ["key", "item"], "left_semi"), limit), "frequent-counts")
    ranks = exact.groupBy("key").agg(F.count("*").alias("ranks"), F.min("n").alias("least"))
    shown = F.when(F.col("ranks") == limit, F.col("least") > F.col("unlisted")).otherwise(F.col("unlisted") < 1)
    judged = stage(listed.join(ranks, "key", "left").select("key", F.coalesce(shown, F.lit(False)).alias("proven")), "proven-words")
    proven = judged.filter("proven").select("key")
    done = exact.join(F.broadcast(proven), "key", "left_semi")
    others = tokens.join(F.broadcast(proven), "key", "left_anti")
    return done.unionByName(_ranked_items(_word_rows(others), limit))


def top_cashtags(assigned: DataFrame, limit: int = MAX_CASHTAGS) -> DataFrame:
    rows = assigned.select(
        "key", "post_order", F.posexplode("tags").alias("position", "item")
    )
    return _ranked_items(rows, limit)


def _as_list(ranked: DataFrame, name: str) -> DataFrame:
    """One array per key; bounded by the rank limit."""
    in_order = F.sort_array(F.collect_list(F.struct("rank", "item")))
    return ranked.groupBy("key").agg(in_order["item"].alias(name))


def group_profiles(assigned: DataFrame, recent: Column | None = None) -> DataFrame:
    """Size, times, platforms and score sums per key.

    The first step aggregates by ``(key, platform)`` before any row moves, so a hot key costs one
    row per task and platform.
    """
    recent = F.lit(True) if recent is None else recent
    by_platform = (
        assigned.withColumn("recent", recent)
        .groupBy("key", "platform")
        .agg(
            F.count("*").alias("n"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.min("post_order").alias("first_post"),
            F.sum(F.col("units") * F.col("weight")).alias("weighted"),
            F.sum("weight").alias("weights"),
            F.count_if("recent").alias("recent_posts"),
            F.sum(F.when(F.col("recent"), F.col("engagement"))).alias("recent_engagement"),
            *limb_sums("id"),
        )
    )
    return by_platform.groupBy("key").agg(
        F.sum("n").alias("n_posts"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first_post").alias("first_post"),
        F.sum("weighted").alias("weighted"),
        F.sum("weights").alias("weights"),
        F.sum("recent_posts").alias("recent_posts"),
        F.sum("recent_engagement").alias("recent_engagement"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        *[F.sum(name).alias(name) for name in LIMBS],
    )


def group_authors(assigned: DataFrame) -> DataFrame:
    """Distinct authors per key up to the number that scores use; no author is shuffled."""
    return assigned.groupBy("key").agg(distinct_up_to("author_id", int(FULL_AUTHORS)).alias("authors"))


def theme_name(cashtags: Column, keywords: Column) -> Column:
    tagged = F.concat(
        F.lit("$"), F.array_join(F.slice(cashtags, 1, 2), ", $"), F.lit(" narrative momentum")
    )
    worded = F.concat(
        title_case(F.coalesce(F.get(keywords, F.lit(0)), F.lit("market"))),
        F.lit(" discussion cluster"),
    )
    return F.when(F.size(cashtags) > 0, tagged).otherwise(worded)


def theme_description(posts: Column, platforms: Column, keywords: Column) -> Column:
    focus = F.when(
        F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 4), ", ")
    ).otherwise(F.lit("broad market chatter"))
    return F.concat(
        F.lit("Cluster of "), posts.cast("string"), F.lit(" posts across "),
        F.array_join(platforms, ", "), F.lit(" focused on "), focus, F.lit("."),
    )


def confidence(posts: Column) -> Column:
    return exact_round(F.least(F.lit(1.0), F.lit(0.45) + F.lit(0.1) * posts), 3)


def theme_id(digest: Column) -> Column:
    return F.concat(F.lit("nar_"), F.substring(digest, 1, THEME_DIGEST_CHARS))


def _small_keys(profiles: DataFrame) -> DataFrame | None:
    """The keys of staged profiles where they are few enough to broadcast."""
    size = profiles.agg(F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0))).first()[0]
    return profiles.select("key") if size <= BROADCAST_BYTES else None


def theme_profiles(
    assigned: DataFrame, min_size: int = MIN_CLUSTER_SIZE, recent: Column | None = None
) -> DataFrame:
    """Profiles of the groups that are large enough to be themes, with their ids.

    Ids follow the members, so what asks for members only (scores) needs no words of the texts.
    """
    return (
        group_profiles(assigned, recent)
        .filter(F.col("n_posts") >= min_size)
        .withColumn("members_digest", members_digest(F.col("n_posts")))
        .withColumn("id", theme_id(F.col("members_digest")))
        .drop(*LIMBS)
    )


def cluster(
    posts: DataFrame, assigned: DataFrame, min_size: int = MIN_CLUSTER_SIZE,
    max_keywords: int = MAX_KEYWORDS, now: Column | datetime | None = None,
    recent: Column | None = None,
) -> DataFrame:
    """Themes of ``posts``, one row per group key, with the sums that scoring needs.

    ``assigned`` is ``assign(posts)``, staged or not.  ``recent`` marks the rows of ``assigned``
    inside the velocity window.  Profiles of groups that are large enough are staged first; words,
    tags and authors are then counted for those groups only, unless their keys are too many to
    broadcast.
    """
    profiles = stage(theme_profiles(assigned, min_size, recent), "profiles")
    kept = _small_keys(profiles)
    narrow = assigned if kept is None else assigned.join(F.broadcast(kept), "key", "left_semi")
    keywords = _as_list(top_keywords(posts, max_keywords, kept), "keywords")
    cashtags = _as_list(top_cashtags(narrow), "cashtags")
    none = F.array().cast("array<string>")
    last_seen = F.col("last_seen")
    return (
        profiles.join(group_authors(narrow), "key")
        .join(keywords, "key", "left")
        .join(cashtags, "key", "left")
        .withColumns(
            {
                "keywords": F.coalesce("keywords", none),
                "cashtags": F.coalesce("cashtags", none),
                "last_seen": last_seen if now is None else F.greatest(last_seen, instant(now)),
                "confidence": confidence(F.col("n_posts")),
            }
        )
        .withColumns(
            {
                "name": theme_name(F.col("cashtags"), F.col("keywords")),
                "description": theme_description(
                    F.col("n_posts"), F.col("platforms"), F.col("keywords")
                ),
            }
        )
    )


def as_narratives(clusters: DataFrame) -> DataFrame:
    """Clusters in the schema of the narratives table; scores not yet present are zero."""
    scores = ("sentiment_score", "velocity_score", "saturation_score", "overall_score")
    absent = [F.lit(0.0).alias(name) for name in scores if name not in clusters.columns]
    filled = clusters.select("*", *absent)
    return filled.select(
        "id", "name", "description", "first_seen", "last_seen", "n_posts",
        "members_digest", "cashtags", "keywords", *scores, F.lit(True).alias("is_active"),
        "confidence",
    )


def membership(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Long form of the member lists: ``narrative_id, post_id``.

    An inner join of narrow rows on the key; adaptive execution splits a hot key.
    """
    themes = clusters.select("key", F.col("id").alias("narrative_id"))
    return (
        assigned.select("key", F.col("id").alias("post_id"))
        .join(themes, "key")
        .select("narrative_id", "post_id")
    )


def ranked(clusters: DataFrame) -> DataFrame:
    """Themes in report order: confidence, size, then the group met first."""
    return clusters.orderBy(F.desc("confidence"), F.desc("n_posts"), "first_post", "key")


def with_rank(clusters: DataFrame, parts: int = 32) -> DataFrame:
    """``clusters`` with ``rank`` (from 1) in report order.

    The order is dealt into ranges; each range is numbered by itself and the sizes of the ranges
    before it (``parts`` numbers) are added, so no task sees all themes.
    """
    order = [F.desc("confidence"), F.desc("n_posts"), F.asc("first_post"), F.asc("key")]
    dealt = stage(
        clusters.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part"))
    return dealt.withColumn("rank", offset + inside).drop("_part")


Labeler = Callable[[list[str], list[str], list[str]], dict]


def sample_texts(posts: DataFrame, per_key: int) -> DataFrame:
    """The ``per_key`` newest texts per key for a labeler: ``key, samples``.

    How many a labeler may see is for the caller to say, because it changes the labels; all the
    texts of a theme fit no call once themes are large.
    """
    texts = posts.select(group_key().alias("key"), post_order().alias("post_order"), "text")
    return (
        first_per_group(texts, ["key"], ["post_order"], per_key, "post_order", "rank")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "text")))["text"].alias("samples"))
    )


def apply_labeler(
    clusters: DataFrame, samples: DataFrame, labeler: Labeler, parallelism: int
) -> DataFrame:
    """Let ``labeler(texts, keywords, cashtags)`` rename themes, ``parallelism`` calls at a time.

    It returns a dict with ``name``, ``description`` and ``keywords``.  A theme whose call fails
    keeps its own wording.  Tags are never replaced.  ``clusters`` is read twice: stage it.
    """
    schema = "key string, _name string, _description string, _keywords array<string>"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    draft = labeler(list(row.samples), list(row.keywords), list(row.cashtags))
                    rows.append((row.key, draft["name"], draft["description"], list(draft["keywords"])))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["key", "_name", "_description", "_keywords"])

    # An explicit count is kept: small shuffles are merged into one task otherwise.
    asked = clusters.select("key", "keywords", "cashtags").join(samples, "key")
    drafts = asked.repartition(parallelism, "key").mapInPandas(label, schema)
    return (
        clusters.join(drafts, "key", "left")
        .withColumns(
            {
                "name": F.coalesce("_name", "name"),
                "description": F.coalesce("_description", "description"),
                "keywords": F.coalesce("_keywords", "keywords"),
            }
        )
        .drop("_name", "_description", "_keywords")
    )


#: Drafts of one theme: what a labeler made of some of its texts, and of how many.
_DRAFT = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("name", T.StringType()),
     T.StructField("description", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
     T.StructField("texts", T.LongType())]
)
Merger = Callable[[list[dict], list[str], list[str]], dict]


def by_description(labeler: Labeler) -> Merger:
    """Merge drafts by giving their names and descriptions to the labeler as texts."""
    return lambda drafts, keywords, cashtags: labeler(
        [f"{d['name']}. {d['description']}" for d in drafts], keywords, cashtags
    )


def _called(
    rows: DataFrame, words: DataFrame, order: list[str], call: Callable[..., tuple], size: int, parallelism: int
) -> DataFrame:
    """Drafts by ``call(rows, keywords, cashtags)`` of at most ``size`` rows of a chunk, in ``order``.

    ``words`` has the words of each ``key, chunk`` of ``rows``.  They stand before the chunk's rows in a sorted
    task, which reads one row after the other and holds the rows of one call only.
    """
    names = [c for c in rows.columns if c not in ("key", "chunk")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, theme, some, made = None, None, [], []

        def finish() -> None:
            if some and theme:
                try:
                    made.append((*at, *call(some, *theme)))
                except Exception:
                    pass
            some.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "chunk", "_words", *names)]
            for key, chunk, found, *values in zip(*columns):
                if (key, chunk) != at:
                    finish()
                    at, theme = (key, chunk), None
                if found is not None:
                    theme = theme or (list(found["keywords"]), list(found["cashtags"]))
                    continue
                some.append(dict(zip(names, values)))
                if len(some) == size:
                    finish()
            if made:
                yield _batch(made)
                made.clear()
        finish()
        if made:
            yield _batch(made)

    # An explicit count is kept: small shuffles are merged into one task otherwise.
    dealt = rows.unionByName(words, allowMissingColumns=True).repartition(parallelism, "key", "chunk")
    in_order = dealt.sortWithinPartitions(
        "key", "chunk", F.col("_words").isNull(), *[F.asc_nulls_last(name) for name in order]
    )
    return stage(in_order.mapInArrow(run, _DRAFT), "drafts")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """``rows`` of drafts as Arrow."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_DRAFT.names)


def label_all_texts(
    clusters: DataFrame, posts: DataFrame, labeler: Labeler, merger: Merger | None = None,
    parallelism: int = 64, texts_per_call: int = 100, drafts_per_call: int = 20,
) -> DataFrame:
    """Let a labeler see every text of each theme, a bounded number of them per call, ``parallelism`` calls at a time.

    The texts of a theme are dealt into chunks by the hash of their post, as many as its size asks for,
    so a theme with a third of all posts is labelled by many tasks.  ``labeler(texts, keywords, cashtags)``
    makes a draft of at most ``texts_per_call`` texts, newest first.  ``merger(drafts, keywords, cashtags)`` makes one
    of at most ``drafts_per_call`` drafts (``name``, ``description``, ``keywords``, ``texts``: how many
    texts they stand for), level by level, until a theme has one; by default the labeler reads the
    drafts' descriptions.  A call that fails leaves its texts out; a theme without any draft keeps its own
    wording.  Tags are never replaced.  ``clusters`` is read several times: stage it.
    """
    if texts_per_call < 1 or drafts_per_call < 2:
        raise ValueError("a call takes a text at least, a merge two drafts")
    merger = merger or by_description(labeler)
    chunks = F.ceil(F.col("n_posts") / texts_per_call)
    themes = clusters.select("key", F.struct("keywords", "cashtags").alias("_words"), chunks.alias("chunks"))
    texts = posts.select(group_key().alias("key"), "id", post_order().alias("post_order"), "text").join(themes, "key")
    # The theme's words travel once per chunk, not with each text.
    dealt = texts.select("key", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), "post_order", "text")
    words = themes.select(
        "key", "_words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    )

    def draft(some: list[dict], keywords: list[str], cashtags: list[str]) -> tuple:
        found = labeler([row["text"] for row in some], keywords, cashtags)
        return found["name"], found["description"], list(found["keywords"]), len(some)

    def merge(some: list[dict], keywords: list[str], cashtags: list[str]) -> tuple:
        parts = [{name: row[name] for name in _DRAFT.names[2:]} for row in some]
        found = parts[0] if len(parts) == 1 else merger(parts, keywords, cashtags)
        return found["name"], found["description"], list(found["keywords"]), sum(d["texts"] for d in parts)

    drafts = _called(dealt, words, ["post_order"], draft, texts_per_call, parallelism)
    while not drafts.groupBy("key").count().filter("count > 1").isEmpty():
        # At least two drafts meet wherever a theme has several, so the levels are few.
        sizes = drafts.groupBy("key").agg(F.count("*").alias("n")).select(
            "key", F.ceil(F.col("n") / drafts_per_call).alias("groups")
        )
        place = F.pmod(F.xxhash64("chunk", "name", "description"), "groups")
        grouped = drafts.join(sizes, "key").withColumn("chunk", place).drop("groups")
        of_group = grouped.select("key", "chunk").distinct().join(themes.select("key", "_words"), "key")
        drafts = _called(grouped, of_group, ["name", "description"], merge, drafts_per_call, parallelism)
    last = drafts.select(
        "key", F.col("name").alias("_name"), F.col("description").alias("_description"), F.col("keywords").alias("_keywords")
    )
    return (
        clusters.join(last, "key", "left")
        .withColumns(
            {
                "name": F.coalesce("_name", "name"),
                "description": F.coalesce("_description", "description"),
                "keywords": F.coalesce("_keywords", "keywords"),
            }
        )
        .drop("_name", "_description", "_keywords")
    )
