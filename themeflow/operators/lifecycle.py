"""Theme state across runs: created, updated, reactivated, unchanged, deactivated.

``reconcile`` is a pure function of the previous state and one batch.  Member lists are compared
by their digest, which stands for the set of members, so no list is ever loaded.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeflow.constants import METRIC_TOLERANCE
from themeflow.functions.core import hours_before, instant
from themeflow.operators.members import digests
from themeflow.schemas import MEMBERSHIP, NARRATIVES, STATE

STALE_HOURS = 48
METRICS = ("sentiment_score", "velocity_score", "saturation_score", "overall_score", "confidence")


@dataclass(frozen=True)
class Reconciled:
    """``rows`` holds every theme of either side; the rest are views of it."""

    rows: DataFrame

    @property
    def state(self) -> DataFrame:
        return self.rows.select(*STATE.fieldNames())

    @property
    def events(self) -> DataFrame:
        """One row per theme of the batch and per deactivated theme."""
        return self.rows.filter(F.col("event").isNotNull()).select(
            F.col("id").alias("narrative_id"), "event", "previous_version", "new_version"
        )

    @property
    def log(self) -> DataFrame:
        """Events to append; ``unchanged`` is not logged."""
        return event_log(self.rows)


def event_log(rows: DataFrame, *extra: str) -> DataFrame:
    """The events that merged ``rows`` stand for; ``unchanged`` is not logged."""
    details = F.when(F.col("event") == "deactivated", F.lit("{}")).otherwise(F.to_json(F.struct("name")))
    return rows.filter(F.col("event").isNotNull() & (F.col("event") != "unchanged")).select(
        F.col("id").alias("narrative_id"),
        F.col("event").alias("event_type"),
        "previous_version",
        "new_version",
        F.col("updated_at").alias("occurred_at"),
        details.alias("details"),
        *extra,
    )


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def from_post_lists(narratives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split narratives that carry a ``post_ids`` array into themes and membership."""
    pairs = narratives.select(F.col("id").alias("narrative_id"), F.explode("post_ids").alias("post_id"))
    found = digests(pairs.distinct(), "narrative_id", "post_id").withColumnRenamed("narrative_id", "id")
    themes = (
        narratives.join(found, "id", "left")
        .withColumn("n_posts", F.size("post_ids").cast("long"))
        .select(*NARRATIVES.fieldNames())
    )
    return themes, pairs.select(*MEMBERSHIP.fieldNames())


def _as_set(tags: Column) -> Column:
    return F.sort_array(F.array_distinct(tags))


def materially_changed(old: str = "old", new: str = "new") -> Column:
    """Wording, members, tags, keywords or a metric differ; times do not matter."""

    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"{old}.{name}"), F.col(f"{new}.{name}")

    changed = F.lit(False)
    for name in ("name", "description", "members_digest"):
        before, after = pair(name)
        changed = changed | ~before.eqNullSafe(after)
    for name in ("cashtags", "keywords"):
        before, after = pair(name)
        changed = changed | ~_as_set(before).eqNullSafe(_as_set(after))
    for name in METRICS:
        before, after = pair(name)
        changed = changed | (F.abs(before - after) > METRIC_TOLERANCE)
    return changed


def reconcile(
    state: DataFrame, batch: DataFrame, as_of: Column | datetime, stale_hours: int = STALE_HOURS
) -> Reconciled:
    """Merge one batch of themes into the state with one full outer join on the id.

    An id that occurs twice in the batch fails the job (see ``unique``).
    """
    old = state.select("id", F.struct(*STATE.fieldNames()).alias("old"))
    new = unique(batch).select("id", F.struct(*NARRATIVES.fieldNames()).alias("new"))
    both = old.join(new, "id", "full_outer")
    known, arrived = F.col("old").isNotNull(), F.col("new").isNotNull()
    stale = (
        known & ~arrived & F.col("old.is_active")
        & (F.col("old.last_seen") < hours_before(as_of, stale_hours))
    )
    event = (
        F.when(arrived & ~known, F.lit("created"))
        .when(arrived & ~F.col("old.is_active"), F.lit("reactivated"))
        .when(arrived & materially_changed(), F.lit("updated"))
        .when(arrived, F.lit("unchanged"))
        .when(stale, F.lit("deactivated"))
    )
    previous = F.coalesce("old.version", F.lit(0).cast("long"))
    bumped = F.col("event").isin("created", "reactivated", "updated", "deactivated")

    def merged(name: str) -> Column:
        return F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    # The state keeps arrays sorted; the rank order of keywords belongs to the batch only.
    kept = {
        name: F.sort_array(merged(name)) if name in ("cashtags", "keywords") else merged(name)
        for name in NARRATIVES.fieldNames()
        if name not in ("id", "is_active")
    }
    # A new theme keeps the flag it comes with; one seen again is active.
    is_active = (
        F.when(arrived & ~known, F.col("new.is_active"))
        .when(arrived, F.lit(True))
        .when(stale, F.lit(False))
        .otherwise(F.col("old.is_active"))
    )
    touched = F.col("event").isNotNull()
    rows = both.withColumn("event", event).select(
        "id",
        *[value.alias(name) for name, value in kept.items()],
        is_active.alias("is_active"),
        "event",
        previous.alias("previous_version"),
        (previous + F.when(bumped, F.lit(1)).otherwise(F.lit(0))).alias("new_version"),
        F.when(touched, instant(as_of)).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )
    return Reconciled(rows.withColumn("version", F.col("new_version")))


def stale_themes(
    state: DataFrame, batch: DataFrame, as_of: Column | datetime, stale_hours: int = STALE_HOURS
) -> DataFrame:
    """Active themes that are not in the batch and were last seen before the cutoff."""
    overdue = state.filter(
        F.col("is_active") & (F.col("last_seen") < hours_before(as_of, stale_hours))
    )
    return overdue.join(batch.select("id"), "id", "left_anti")


def active_themes(state: DataFrame) -> DataFrame:
    return state.filter("is_active").orderBy(F.desc("overall_score"), F.desc("confidence"))


def unique(narratives: DataFrame) -> DataFrame:
    """``narratives``, whose rows fail when their id occurs more than once.

    Lazy: copies are counted in the partitioning that the merge needs anyway.
    """
    copies = F.count("*").over(Window.partitionBy("id"))
    message = F.concat(F.lit("narrative "), F.col("id"), F.lit(" occurs more than once in the batch"))
    return narratives.withColumn("_copies", copies).withColumn(
        "id", F.when(F.col("_copies") == 1, F.col("id")).otherwise(F.raise_error(message).cast("string"))
    ).drop("_copies")


def assert_unique(narratives: DataFrame) -> None:
    """Fail at once when an id occurs twice in one batch."""
    repeated = narratives.groupBy("id").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"narrative {repeated[0]['id']} occurs more than once in the batch")
