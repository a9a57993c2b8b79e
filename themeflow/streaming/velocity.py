"""Velocity of themes over sliding event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.functions.core import engagement
from themeflow.operators.cluster import group_key
from themeflow.operators.scoring import WINDOW_HOURS, check_window, velocity_score


def keyed(posts: DataFrame) -> DataFrame:
    return posts.select("created_at", group_key().alias("key"), engagement().alias("engagement"))


def windowed_velocity(
    keyed_posts: DataFrame, hours: int = WINDOW_HOURS, slide_hours: int = 1, delay: str = "1 hour"
) -> DataFrame:
    """``key, window_start, window_end, posts, velocity_score`` per sliding window.

    Works on streams and tables.  Posts are summed per slide first and only those sums are copied
    into the windows they belong to, not every post ``hours / slide_hours`` times.  State holds
    one row per key and open slide or window; a stream drops rows later than the watermark.
    A window holds its end and not its start, as the velocity of a theme at a clock does: event times
    are one microsecond earlier here, the smallest step they have.  Late rows: one that is at most
    ``delay`` older than the newest row of the batches before is counted, in windows that are still
    open; an older one is dropped, and the stream's progress counts it
    (``numRowsDroppedByWatermark``).
    """
    check_window(hours)
    if hours % slide_hours:
        raise ValueError("the window must be a whole number of slides")
    shifted = keyed_posts.withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 1 MICROSECOND"))
    per_slide = (
        shifted.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", f"{slide_hours} hours"), "key")
        .agg(F.count("*").alias("posts"), F.sum("engagement").alias("engagement"))
    )
    sliding = F.window(F.window_time("window"), f"{hours} hours", f"{slide_hours} hours")
    return (
        per_slide.groupBy(sliding, "key")
        .agg(F.sum("posts").alias("posts"), F.sum("engagement").alias("engagement"))
        .select(
            "key",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "posts",
            velocity_score(F.col("posts"), F.col("engagement"), hours).alias("velocity_score"),
        )
    )
