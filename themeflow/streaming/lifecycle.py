"""Theme lifecycle over a stream of posts, as keyed state with timers.

Two queries share a folder.  ``theme_stream`` turns each batch of posts into themes with the batch's
clock and appends them.  ``lifecycle_stream`` reads these as a stream keyed by theme id: the state of
a theme lives in the state store and a timer says when it goes stale, so a batch reads and writes
only the themes that it holds and those that are due.  What it writes is one row per touched theme;
events and state are views of these rows.

The rules are those of ``operators.lifecycle.reconcile``; where a micro-batch is one batch of themes,
the events are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from themeflow.constants import METRIC_TOLERANCE
from themeflow.operators import lifecycle
from themeflow.schemas import NARRATIVES, STATE

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MICROS = 3_600_000_000
_TIMES = ("first_seen", "last_seen")
_TOUCHED = T.StructType(
    [*STATE.fields, T.StructField("event", T.StringType()), T.StructField("previous_version", T.LongType()),
     T.StructField("new_version", T.LongType())]
)
_CLOCK = T.StructField("clock", T.TimestampType())
_INPUT = [*NARRATIVES.fieldNames(), "clock"]


def _in_micros(schema: T.StructType) -> T.StructType:
    """Times as whole microseconds, which mean the same in every time zone."""
    return T.StructType(
        [T.StructField(f.name, T.LongType()) if isinstance(f.dataType, T.TimestampType) else f for f in schema]
    )


# --- Posts to themes --------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _clock_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """Microseconds of the clock of the batches before."""
    clocks = _read(spark, f"{path}/clocks", T.StructType([_CLOCK, T.StructField("batch_id", T.LongType())]))
    if clocks is None:
        return None
    return clocks.filter(F.col("batch_id") == batch_id - 1).agg(F.max(F.unix_micros("clock"))).first()[0]


def write_themes(
    batch: DataFrame, batch_id: int, path: str, narratives_of: Callable[[DataFrame], DataFrame]
) -> None:
    """Themes of one batch of posts with its clock, the time of the newest post.

    The clock never stands still or goes back: a batch that is no newer than the one before is one
    millisecond later.  Each batch has its own folder, which it replaces when it is run again.
    """
    spark = batch.sparkSession
    newest = batch.agg(F.max(F.unix_micros("created_at"))).first()[0]
    before = _clock_before(spark, path, batch_id)
    clock = newest if before is None else before if newest is None else max(newest, before + 1000)
    instant = F.timestamp_micros(F.lit(clock).cast("long"))
    if newest is not None:
        themes = lifecycle.unique(narratives_of(batch)).select(*NARRATIVES.fieldNames(), instant.alias("clock"))
        themes.write.mode("overwrite").parquet(f"{path}/themes/batch_id={batch_id}")
    tick = spark.range(1).select(instant.alias("clock"))
    tick.write.mode("overwrite").parquet(f"{path}/clocks/batch_id={batch_id}")


def theme_stream(
    posts: DataFrame, path: str, checkpoint: str, narratives_of: Callable[[DataFrame], DataFrame]
) -> DataStreamWriter:
    """``narratives_of`` turns the posts of one batch into themes with unique ids."""
    return posts.writeStream.foreachBatch(
        lambda batch, batch_id: write_themes(batch, batch_id, path, narratives_of)
    ).option("checkpointLocation", checkpoint)


# --- Themes to events -------------------------------------------------------------------------


def _differs(old: dict[str, Any], new: dict[str, Any]) -> bool:
    """``operators.lifecycle.materially_changed`` for one theme."""
    same = all(old[c] == new[c] for c in ("name", "description", "members_digest"))
    for c in ("cashtags", "keywords"):
        before, after = (None if x[c] is None else set(x[c]) for x in (old, new))
        same = same and before == after
    pairs = ((old[c], new[c]) for c in lifecycle.METRICS)
    return not same or any(a is not None and b is not None and abs(a - b) > METRIC_TOLERANCE for a, b in pairs)


class ThemeProcessor(StatefulProcessor):
    """One theme: its last state, and a timer for going stale.

    Timers and watermarks have milliseconds; here each stands for a microsecond of the clock.
    """

    def __init__(self, stale_hours: int) -> None:
        self._stale = stale_hours * HOUR_MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._theme = handle.getValueState("theme", _in_micros(STATE))

    def _load(self) -> dict[str, Any] | None:
        if not self._theme.exists():
            return None
        return dict(zip(STATE.fieldNames(), self._theme.get()))

    def _keep(self, theme: dict[str, Any]) -> None:
        self._theme.update(tuple(theme[c] for c in STATE.fieldNames()))

    def _wake_at(self, theme: dict[str, Any]) -> int:
        """The last clock at which the theme isn't stale: never before that of the batch it came with."""
        return max(theme["last_seen"] + self._stale, theme["updated_at"])

    def _due(self, theme: dict[str, Any] | None, now: int) -> bool:
        return bool(theme and theme["is_active"] and self._wake_at(theme) < now)

    def _deactivated(self, theme: dict[str, Any], now: int) -> tuple[dict[str, Any], Row]:
        old = theme["version"]
        theme = theme | {"is_active": False, "version": old + 1, "updated_at": now}
        return theme, self._row(theme, "deactivated", old)

    @staticmethod
    def _row(theme: dict[str, Any], event: str, old_version: int) -> Row:
        after = {"event": event, "previous_version": old_version, "new_version": theme["version"]}
        return Row(**{c: theme[c] for c in STATE.fieldNames()}, **after)

    def _wake(self, theme: dict[str, Any]) -> None:
        """One timer, for the first clock at which the theme is stale."""
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if theme["is_active"]:
            self._handle.registerTimer(self._wake_at(theme))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old, now = self._load(), timerValues.getCurrentWatermarkInMs()
        for row in sorted((dict(zip(_INPUT, r)) for r in rows), key=lambda r: r["clock"]):
            if old is not None and row["clock"] <= old["updated_at"]:
                continue  # a batch that was written again
            if self._due(old, now):
                old, event = self._deactivated(old, now)
                yield event
            new = {c: row[c] for c in NARRATIVES.fieldNames()} | {"updated_at": row["clock"]}
            for c in ("cashtags", "keywords"):
                new[c] = None if new[c] is None else sorted(new[c])
            version = old["version"] if old else 0
            if old is None:
                event = "created"
            else:
                event = "reactivated" if not old["is_active"] else "updated" if _differs(old, new) else "unchanged"
                new["is_active"] = True
            new["version"] = version + (event != "unchanged")
            yield self._row(new, event, version)
            old = new
        if old is not None:
            self._keep(old)
            self._wake(old)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        theme, now = self._load(), timerValues.getCurrentWatermarkInMs()
        if self._due(theme, now):
            theme, event = self._deactivated(theme, now)
            self._keep(theme)
            yield event
        elif theme and theme["is_active"]:
            self._handle.registerTimer(max(now, self._wake_at(theme)) + 1)

    def close(self) -> None:
        pass


def touched_themes(themes: DataFrame, stale_hours: int = lifecycle.STALE_HOURS) -> DataFrame:
    """Stream of the touched themes' new state with ``event``, ``previous_version`` and ``new_version``.

    ``themes`` is a stream of themes with ``clock``.  A theme goes stale when a later batch has a clock
    more than ``stale_hours`` past the theme's last post.
    """
    times = {c: F.unix_micros(c) for c in (*_TIMES, "clock")}
    # The watermark's milliseconds count the clock's microseconds.  Such times are far in the future, so tasks don't get them.
    tick = F.timestamp_millis(F.unix_micros("clock"))
    marked = themes.withColumn("tick", tick).withColumns(times).withWatermark("tick", "0 seconds")
    found = marked.select(*_INPUT).groupBy("id").transformWithState(
        ThemeProcessor(stale_hours), _in_micros(_TOUCHED), outputMode="Append", timeMode="EventTime"
    )

    def back(field: T.StructField) -> Column:
        value = F.col(field.name)
        return (F.timestamp_micros(value) if isinstance(field.dataType, T.TimestampType) else value).alias(field.name)

    return found.select(*[back(f) for f in _TOUCHED])


def read_theme_stream(spark: SparkSession, path: str) -> DataFrame:
    """The themes that ``theme_stream`` appends, as a stream."""
    return spark.readStream.schema(T.StructType([*NARRATIVES.fields, _CLOCK])).parquet(f"{path}/themes")


def lifecycle_stream(
    themes: DataFrame, path: str, checkpoint: str, stale_hours: int = lifecycle.STALE_HOURS
) -> DataStreamWriter:
    """Append the touched themes of each micro-batch; one that is run again replaces its folder."""
    themes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/touched/batch_id={batch_id}")

    return touched_themes(themes, stale_hours).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --- Reading ----------------------------------------------------------------------------------


def read_touched(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*_TOUCHED.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/touched")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log with the number of the micro-batch."""
    return lifecycle.event_log(read_touched(spark, path), "batch_id")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each theme."""
    order = F.struct("updated_at", "version")
    last = F.max_by(F.struct(*STATE.fieldNames()), order)
    return read_touched(spark, path).groupBy("id").agg(last.alias("last")).select("last.*")
