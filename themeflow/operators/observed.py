"""Counts of what passes a point of a job, collected by the job itself and not by another scan.

Counts at the end of a job (its last stage) are exact.  Those before a shuffle are for information:
a stage that is run again because an executor was lost counts its rows again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Named counts, known once a job that they are part of has run to its end."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def seen(self, rows: DataFrame, name: str, conditions: Mapping[str, Column]) -> DataFrame:
        """``rows`` as they are; counts all of them (``rows``) and those of each condition."""
        if name in self._seen:
            raise ValueError(f"{name} is watched already")
        self._seen[name] = Observation(name)
        counted = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]
        return rows.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *counted)

    def counts(self, name: str) -> dict[str, int]:
        """The counts of ``name``; none where nothing was watched.  Waits for the job."""
        return dict(self._seen[name].get) if name in self._seen else {}


def keep(rows: DataFrame, reasons: Mapping[str, Column], watch: Watch | None, name: str) -> DataFrame:
    """``rows`` to which no reason applies; a watch counts the others by their first reason."""
    bad, first = F.lit(False), {}
    for reason, condition in reasons.items():
        condition = F.coalesce(condition, F.lit(True))
        first[reason] = condition & ~bad
        bad = bad | condition
    watched = rows if watch is None else watch.seen(rows, name, first)
    return watched.filter(~bad)
