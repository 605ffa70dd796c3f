"""Timestamps: naive input is local time, stored values are UTC instants (the session's zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

ZONE = "Asia/Shanghai"

_DAY = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?(\d))?"
_ISO = rf"^(?:{_DAY})(?:[T ]\d{{2}}(?::?\d{{2}}(?::?\d{{2}}(?:[.,]\d{{1,9}})?)?)?)?(Z|[+-]\d{{2}}(?::?\d{{2}})?)?$"
_LOOSE = (("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"))


def parse_timestamp(c: Column, zone: str = ZONE) -> Column:
    """ISO date (by month, or by week and day) or date and time with or without offset, or
    year-month-day with '-', '/' or '.'; null for anything else. Text without an offset is local
    time in `zone`."""

    def of(text: Column) -> Column:
        # The two forms that nearly all texts have need no further look.
        plain = F.to_utc_timestamp(text.try_cast("timestamp"), zone)
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2})?$"), plain).otherwise(_instant(text, zone))

    return let(F.replace(strip(c.cast("string")), F.lit("/"), F.lit("-")), of)


def week_date(text: Column) -> Column:
    """The day that a text in ISO weeks begins with, as yyyy-MM-dd; the week's first one where it
    names none, null where there is no such week or day."""
    year, week, day = (F.regexp_extract(text, _WEEK, k).try_cast("int") for k in (1, 2, 3))
    first = F.date_trunc("week", F.concat(F.regexp_extract(text, _WEEK, 1), F.lit("-01-04")).try_cast("date")).cast("date")
    day = F.coalesce(day, F.when(F.regexp_extract(text, _WEEK, 3) == "", 1))
    found = F.date_add(first, (week - 1) * 7 + day - 1)
    right = (week >= 1) & (day >= 1) & (day <= 7) & (F.weekofyear(found) == week) & (year >= 1)
    return F.when(right, F.date_format(found, "yyyy-MM-dd"))


def _instant(text: Column, zone: str) -> Column:
    day = F.regexp_replace(F.regexp_extract(text, rf"^({_DAY})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(text.rlike(_WEEK), week_date(text)).otherwise(day)
    clock = F.regexp_replace(F.regexp_extract(text, rf"^(?:{_DAY})[T ]([\d:.,]*)", 1), ",", ".")
    clock = F.regexp_replace(F.regexp_replace(clock, r"^(\d{2})(\d{2})", "$1:$2"), r"^(\d{2}:\d{2})(\d{2})", "$1:$2")
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 2, F.concat(clock, F.lit(":00:00"))).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(F.substring(clock, 1, 15))
    offset = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, _ISO, 1), r"^([+-]\d{2})(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00")
    local = F.concat(day, F.lit(" "), clock)
    iso = F.when(offset != "", F.concat(local, F.when(offset == "Z", "+00:00").otherwise(offset)).try_cast("timestamp")).otherwise(F.to_utc_timestamp(local.try_cast("timestamp"), zone))
    loose = F.coalesce(*(F.when(text.rlike(p), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(f)), zone)) for f, p in _LOOSE))
    return F.coalesce(F.when(text.rlike(_ISO), iso), loose)


def local_date(c: Column, zone: str = ZONE) -> Column:
    """Calendar date in `zone` of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(c, zone))


def local_start(c: Column, zone: str = ZONE) -> Column:
    """UTC instant of local midnight."""
    return F.to_utc_timestamp(c.cast("timestamp"), zone)


def local_text(c: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd HH:mm")


def end_day_text(c: Column, zone: str = ZONE) -> Column:
    """The last day of a window whose end is stored exclusive."""
    return F.date_format(F.date_sub(local_date(c, zone), 1), "yyyy-MM-dd")
