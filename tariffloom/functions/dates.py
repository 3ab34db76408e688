"""Calendar days and instants; the day of reference is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names, in order.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]


def days_left(due: Column, as_of: Column) -> Column:
    return F.datediff(due, as_of)


def level(days: Column, within: int) -> Column:
    return F.when(days < 0, "overdue").when(days <= within, "due").otherwise("soon")


def level_rank(x: Column) -> Column:
    return F.when(x == "overdue", 3).when(x == "due", 2).when(x == "soon", 1)


def day_text(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "dd/MM/yyyy"), F.lit("—"))


def export_day(x: Column) -> Column:
    """``yyyy-MM-dd...`` as dd-MMM-yyyy; null if it doesn't begin so."""
    return F.date_format(F.substring(x, 1, 10).try_cast("date"), "dd-MMM-yyyy")


def stamp(x: Column, with_time: bool = False) -> Column:
    """An instant's day, and minute, in India; a dash for none."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(x, F.current_timezone()), "Asia/Kolkata")
    return F.coalesce(F.date_format(local, "dd/MM/yyyy HH:mm" if with_time else "dd/MM/yyyy"), F.lit("—"))


def in_order(first: Column, second: Column) -> Column:
    """Whether the second day isn't before the first; unknown days raise no objection."""
    return F.coalesce(second >= first, F.lit(True))


def relative_time(seconds: Column) -> Column:
    """Floor of seconds in the largest fitting unit."""
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, " min ago")).when(seconds < 86400, unit(3600, " h ago")).when(seconds < 7 * 86400, unit(86400, " d ago")).otherwise("earlier")


def shelf_life_left(made: Column, expires: Column, now: Column) -> Column:
    """Percent of the shelf life that is left, for goods that expire after they are made and after now."""
    share = F.datediff(expires, now) * F.lit(100).cast("decimal(5,0)") / F.datediff(expires, made)
    return F.when((expires > made) & (expires > now), F.round(share.cast("decimal(20,10)"), 2).cast("decimal(8,2)"))


def sunset(text: Column) -> Column:
    """The day after which an entry says it shall have no effect."""
    # a fixed pattern
    pattern = r"(?i)shall have effect after the ([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Z][a-z]+),?\s+([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, 2)))
    day = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    return F.when(month > 0, day.try_cast("date"))


def last_free_day(own_days: Column, own_from: Column, days: Column, start: Column, eta: Column) -> Column:
    return F.date_add(F.coalesce(own_from, start, eta), F.coalesce(own_days, days))
