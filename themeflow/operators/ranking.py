"""First rows per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeflow.operators.staging import stage

# Up to this rank Spark cuts each task's rows before the shuffle by itself
# (spark.sql.optimizer.windowGroupLimitThreshold).
DIRECT_LIMIT = 1000


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], limit: int,
    spread_by: str, rank: str | None = None, direct_limit: int = DIRECT_LIMIT, staged: bool = False,
) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, with their ``rank`` if it is named.

    For a higher limit than Spark cuts by itself the rows are staged and numbered in ranges of
    ``order``, so a group with a third of all rows never meets in one task; ``spread_by`` parts rows
    that are equal in ``order``.  ``staged`` says that ``df`` reads staged rows: they aren't staged again
    where no group exceeds the limit and no rank is asked for.
    """
    if limit > direct_limit:
        if staged and rank is None and _none_exceeds(df, group, limit):
            return df
        return _first_of_many(df, group, order, limit, spread_by, rank)
    name = rank or "_rank"
    window = Window.partitionBy(*group).orderBy(*order)
    found = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)
    return found.withColumn(rank, F.col(rank).cast("long")) if rank else found.drop(name)


def _none_exceeds(df: DataFrame, group: Sequence[str], limit: int) -> bool:
    return df.groupBy(*group).count().filter(F.col("count") > limit).isEmpty()


def _first_of_many(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], limit: int, spread_by: str, rank: str | None
) -> DataFrame:
    """``first_per_group`` for high limits: rows are read once, staged, and ranked by their numbers.

    Only group and order columns are dealt into ranges and numbered there; the sizes of a group's
    ranges before it are added.  Where no group exceeds the limit and no rank is asked for, the staged
    rows are the result.
    """
    numbered_rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = stage(numbered_rows, "rows-to-rank", compression="zstd", release=True)
    if rank is None and _none_exceeds(rows, group, limit):
        return rows.drop("__row")
    by = [*group, *order, spread_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    numbered = stage(
        dealt.select(
            "__row", *group, F.spark_partition_id().alias("_salt"), F.monotonically_increasing_id().alias("__at"),
        ),
        "numbered-rows",
        release=True,
    )
    # Each group is counted in its parts, the ranges; only their sizes meet by group.
    ranges = numbered.groupBy("_salt", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    earlier = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low") + 1
    ranges = ranges.select(
        F.col("_salt").alias("__salt_of"), *[F.col(c).alias(f"__{c}_of") for c in group], shift.alias("__shift")
    )
    same = F.col("_salt") == F.col("__salt_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}_of"))
    name = rank or "__rank"
    places = numbered.join(ranges, same).select("__row", (F.col("__at") + F.col("__shift")).alias(name))
    found = rows.join(places.filter(F.col(name) <= limit), "__row").drop("__row")
    return found if rank else found.drop(name)
