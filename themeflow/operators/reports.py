"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.functions.text import word_count
from themeflow.operators.sentiment import label
from themeflow.operators.staging import stage

TITLES_PER_PART = 1000


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("n")).orderBy("event")


def sentiment_report(scored: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Report line per theme: name, label, score, size, tags, six keywords, overall score."""
    none = F.lit("N/A")
    return scored.select(
        *extra,
        "name",
        F.upper(label(F.col("sentiment_score"))).alias("label"),
        "sentiment_score",
        "n_posts",
        F.coalesce(F.nullif(F.array_join("cashtags", ", "), F.lit("")), none).alias("cashtags"),
        F.coalesce(
            F.nullif(F.array_join(F.slice("keywords", 1, 6), ", "), F.lit("")), none
        ).alias("keywords"),
        "overall_score",
    )


def corpus_summary(
    documents: DataFrame, position: str, titles_per_part: int = TITLES_PER_PART
) -> DataFrame:
    """Text summary of a corpus as ``part, text``; the texts joined in part order are the summary.

    ``documents`` has ``title``, ``content`` and a unique whole-number ``position``.  The title list
    grows with the corpus, so it is written in parts of consecutive positions.  The texts are
    read once, into the staged parts.
    """
    part = F.floor(F.col(position) / F.lit(titles_per_part))
    rows = documents.select(
        part.alias("_part"),
        F.col(position).alias("_position"),
        F.coalesce("title", F.lit("<untitled>")).alias("_title"),
        word_count(F.coalesce("content", F.lit(""))).alias("_words"),
    )
    per_part = rows.groupBy("_part").agg(
        F.count("*").alias("n"),
        F.sum("_words").alias("words"),
        F.array_join(
            F.sort_array(F.collect_list(F.struct("_position", "_title")))["_title"], ", "
        ).alias("titles"),
    )
    per_part = stage(per_part, "summary")
    totals = per_part.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("n"),
        F.sum("words").cast("string").alias("words"),
        F.min("_part").alias("first"), F.max("_part").alias("last"),
    )
    empty = F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.lit("No narratives provided.").alias("text"))
    )
    head = F.struct(
        (F.col("first") - 1).alias("part"),
        F.concat(F.lit("Narratives ("), "n", F.lit(" items): ")).alias("text"),
    )
    tail = F.struct(
        (F.col("last") + 1).alias("part"),
        F.concat(F.lit(". Total word count: "), "words", F.lit(".")).alias("text"),
    )
    frame = totals.select(
        F.inline(F.when(F.col("first").isNull(), empty).otherwise(F.array(head, tail)))
    )
    joint = F.when(F.col("_part") > per_part.agg(F.min("_part")).scalar(), F.lit(", ")).otherwise(F.lit(""))
    body = per_part.select(F.col("_part").alias("part"), F.concat(joint, "titles").alias("text"))
    return frame.unionByName(body)


def ingest_summary(results: DataFrame, stats: DataFrame) -> DataFrame:
    """One line per source run with the store counts beside it.

    ``results`` has ``source, started_at, completed_at, posts_stored, duplicates_skipped, errors,
    success``; ``stats`` is the one row of ``store.stats``.
    """
    names = ("total_posts", "twitter", "reddit", "news", "podcast", "unprocessed")
    counts = stats.select(F.struct(*names)).scalar()  # one subquery, so one scan of the store
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1_000_000)
    return results.select(
        "source",
        "success",
        F.round(seconds, 1).alias("duration_seconds"),
        "posts_stored",
        "duplicates_skipped",
        F.size("errors").cast("long").alias("error_count"),
        F.slice("errors", 1, 3).alias("first_errors"),
        counts.alias("_counts"),
    ).select("*", *[F.col("_counts")[name].alias(name) for name in names]).drop("_counts")


def narrative_documents(narratives: DataFrame, membership: DataFrame) -> DataFrame:
    """JSON documents ``id, kind, post_id, document``, the same form for every size.

    A theme is one ``theme`` document with the number of its posts; each member is one ``member``
    document, so no document grows with a theme.
    """
    fields = [
        "id", "name", "description", "first_seen", "last_seen", "n_posts", "cashtags", "keywords",
        "sentiment_score", "velocity_score", "saturation_score", "overall_score", "is_active",
        "confidence",
    ]
    themes = narratives.select(
        "id",
        F.lit("theme").alias("kind"),
        F.lit(None).cast("string").alias("post_id"),
        F.to_json(F.struct(*fields)).alias("document"),
    )
    members = membership.select(
        F.col("narrative_id").alias("id"),
        F.lit("member").alias("kind"),
        "post_id",
        F.to_json(F.struct("narrative_id", "post_id")).alias("document"),
    )
    return themes.unionByName(members)
