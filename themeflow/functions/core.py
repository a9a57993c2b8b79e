"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.constants import BLANK


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    A higher-order function evaluates an outer expression again for every element; binding it
    as a lambda variable keeps such bodies linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters will test.

    Spark pushes a filter below an ordinary projection and then evaluates the expression for the
    filter and again for the column.  It does not push filters below an explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def exact_round(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``round`` works on the printed decimal and rounds ties up, so 0.33335 would give 0.3334
    although the double lies below it.  ``format_number`` rounds the binary value.  Adding 0.0
    turns -0.0 into 0.0.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(pattern)).cast("double") + F.lit(0.0)


def instant(value: Column | datetime) -> Column:
    """A point in time given as a column (for example a scalar subquery) or a datetime."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def hours_before(as_of: Column | datetime, hours: int) -> Column:
    return instant(as_of) - F.make_interval(hours=F.lit(hours))


def strip(value: Column | str) -> Column:
    """Remove every kind of leading and trailing blank; ``trim`` removes spaces only."""
    return F.regexp_replace(col(value), rf"^[{BLANK}]+|[{BLANK}]+$", "")


def or_else(value: Column, default: Column | str) -> Column:
    """``value`` unless it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def digest_id(prefix: str, seed: Column, chars: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(seed), 1, chars))


def engagement() -> Column:
    return F.col("likes") + F.col("replies") + F.col("reposts")


def distinct_up_to(value: Column | str, most: int) -> Column:
    """Aggregate: the number of distinct values, or ``most`` where there are more; nulls don't count.

    A theta sketch keeps all hashes while they are few, so up to its size, which is over ``most``, its
    estimate is the exact number; beyond, it can't fall below its size.  So a task passes on a bounded
    number of hashes per group, however many values it has met.  Values get a prefix because
    sketches leave out empty strings.
    """
    entries_log2 = max(4, most.bit_length() + 1)
    found = F.theta_sketch_estimate(F.theta_sketch_agg(F.concat(F.lit("+"), col(value)), F.lit(entries_log2)))
    return F.least(F.coalesce(found, F.lit(0)), F.lit(most)).cast("long")


def post_order() -> Column:
    """Position of a post in reading order (newest first) as one fixed-width number.

    Spark keeps decimals of any precision in hash-aggregation buffers, but neither strings nor
    structs, so ``min(post_order)`` stays a hash aggregate where ``min(struct(...))`` would sort
    every exploded word.  Digits: 18 for time (years 1 to 9999), 11 for a digest of the id (posts of
    one instant have no order of their own), 9 for a position inside the post.
    """
    newest_first = F.lit(26 * 10**16).cast("decimal(18,0)") - F.unix_micros("created_at").cast("decimal(18,0)")
    tie = F.conv(F.substring(F.sha1("id"), 1, 9), 16, 10).cast("decimal(11,0)")
    of_post = (newest_first.cast("decimal(18,0)") * F.lit(10**11).cast("decimal(12,0)") + tie).cast("decimal(29,0)")
    return (of_post * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")


def order_in_post(order: Column, position: Column) -> Column:
    """Position of an item inside a post, comparable across posts; equal from the 10**9th item on."""
    return (order + F.least(position, F.lit(10**9 - 1)).cast("decimal(9,0)")).cast("decimal(38,0)")
