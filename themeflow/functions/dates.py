"""Date parsing.  Unreadable input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeflow.constants import ZONE_OFFSETS
from themeflow.functions.core import col, let

# --- fixed values: accepted date shapes ---------------------------------------------------
_ISO = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(-?[1-7])?)"
    r"([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(.*)$"
_RFC_2822 = (
    r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+(\S+))?.*$"
)
_ASCTIME = r"^\s*[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}:\d{2})\s+(\d{4})\s*$"
# Two-digit years from this one on belong to the last century.
_CENTURY = 69


def _from_week(text: Column) -> Column:
    """A week date with its calendar date in place; other texts as they are."""
    year, week, day = (F.regexp_extract(text, _WEEK, i).try_cast("int") for i in (1, 2, 3))
    fourth = F.make_date(F.coalesce(year, F.lit(1970)), F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    date = F.date_add(monday, (week - 1) * 7 + F.coalesce(day, F.lit(1)) - 1)
    written = F.concat(F.date_format(date, "yyyy-MM-dd"), F.regexp_extract(text, _WEEK, 4))
    return F.when(text.rlike(_WEEK) & week.between(1, 53), written).otherwise(text)


def parse_iso(value: Column | str) -> Column:
    """ISO 8601 date or date and time; without an offset it is read as UTC.

    Extended and basic form, calendar and week dates, times down to the hour.
    """
    text = let(F.regexp_replace(col(value), ",", "."), _from_week)
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    text = F.regexp_replace(text, r"([T ]\d{2})(\d{2})(\d{2})(?=$|[.Z+-])", "$1:$2:$3")
    text = F.regexp_replace(text, r"([T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")
    text = F.regexp_replace(text, r"([T ]\d{2})(?=$|[Z+-])", "$1:00")
    text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    # The offset rewrite must not touch the day of a bare date.
    text = F.regexp_replace(text, r"([T ].*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(col(value).rlike(_ISO), text.try_cast("timestamp"))


def parse_epoch_seconds(value: Column | str) -> Column:
    return F.timestamp_seconds(col(value))


def parse_rfc2822(value: Column | str) -> Column:
    """Mail-style date such as ``Thu, 05 Mar 2026 15:00:00 GMT``, or ``Thu Mar  5 15:00:00 2026``.

    Spark's formatter does not read weekdays, so the fields are picked out first.  An unknown or
    missing zone is read as UTC; years of two digits are those from 1969 to 2068.
    """
    text = col(value)

    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC_2822, group)

    offsets = F.create_map(*[F.lit(item) for pair in ZONE_OFFSETS.items() for item in pair])
    zone = F.when(part(7).rlike(r"^[+-]\d{4}$"), part(7)).otherwise(
        F.coalesce(F.try_element_at(offsets, F.upper(part(7))), F.lit("+0000"))
    )
    century = F.when(part(3).try_cast("int") >= _CENTURY, F.lit("19")).otherwise(F.lit("20"))
    year = F.when(F.length(part(3)) == 2, F.concat(century, part(3))).otherwise(part(3))
    written = F.concat_ws(
        " ",
        part(1),
        F.initcap(part(2)),
        year,
        F.concat_ws(":", F.lpad(part(4), 2, "0"), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))),
        zone,
    )
    month, day, time, whole = (F.regexp_extract(text, _ASCTIME, i) for i in (1, 2, 3, 4))
    plain = F.concat_ws(" ", day, F.initcap(month), whole, F.lpad(time, 8, "0"), F.lit("+0000"))
    shape = F.lit("d MMM yyyy HH:mm:ss xx")
    return F.when(text.rlike(_RFC_2822), F.try_to_timestamp(written, shape)).when(
        text.rlike(_ASCTIME), F.try_to_timestamp(plain, shape)
    )
