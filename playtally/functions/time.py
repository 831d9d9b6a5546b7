"""Time expressions on zone-less timestamps.

Everything goes through TIMESTAMP_NTZ, so results do not depend on
``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone in which a viewing day begins and ends.
EVENT_ZONE = "EST5EDT"

_EPOCH = dt.datetime(1970, 1, 1)

# The summary grains and the unit each one truncates to.
GRAINS = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}


def _ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def _epoch() -> Column:
    return _ntz(F.lit(_EPOCH.isoformat(sep=" ")))


def _as_day(day: dt.date | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(day)


def local_day(epoch_seconds: Column, zone: str = EVENT_ZONE) -> Column:
    """Calendar day, in ``zone``, of a moment given in epoch seconds."""
    moment = F.timestamp_add("SECOND", epoch_seconds, _epoch())
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment).cast("date")


def event_day(epoch_ms: Column, zone: str = EVENT_ZONE) -> Column:
    """Calendar day, in ``zone``, of an event stamped in epoch milliseconds."""
    return local_day(F.call_function("div", epoch_ms, F.lit(1000)), zone)


def local_day_start(day: dt.date | Column, zone: str = EVENT_ZONE) -> Column:
    """Epoch seconds at which ``day`` begins in ``zone``.

    For a literal day this folds to a constant, so a comparison with it is
    pushed down to the scan.
    """
    midnight = _ntz(_as_day(day))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)
    return F.timestamp_diff("SECOND", _epoch(), utc)


def on_local_day(
    epoch_seconds: Column,
    first_day: dt.date | Column,
    last_day: dt.date | Column | None = None,
    zone: str = EVENT_ZONE,
) -> Column:
    """Half-open test: the moment falls on a local day of the given range."""
    first = _as_day(first_day)
    last = first if last_day is None else _as_day(last_day)
    return (epoch_seconds >= local_day_start(first, zone)) & (
        epoch_seconds < local_day_start(F.date_add(last, 1), zone)
    )


def day_of_epoch_ms(text: Column) -> Column:
    """UTC day of a moment in epoch milliseconds, as text or number; null if it is none."""
    milliseconds = text.try_cast("bigint")
    seconds = F.floor(milliseconds / 1000)
    return F.timestamp_add("SECOND", seconds, _epoch()).cast("date")


def first_request_day(text: Column) -> Column:
    """First day of a request in ISO text, as `params.days_from_text` reads it.

    A start at the first second of a day names that day, whatever its offset; other
    moments are taken in UTC.
    """
    named = F.substring(text, 1, 10).cast("date")
    return F.when(text.contains("T00:00:00"), named).otherwise(_utc_day(text))


def last_request_day(text: Column) -> Column:
    """Last day of a request: an end is exclusive, unless it is the last second of a day."""
    named = F.substring(text, 1, 10).cast("date")
    return F.when(text.contains("T23:59:59"), named).otherwise(F.date_sub(_utc_day(text), 1))


def _utc_day(text: Column) -> Column:
    """Day, in UTC, of a moment in ISO text; without an offset it is in UTC."""
    offset = F.regexp_extract(text, r"T.*([+-])(\d\d):?(\d\d)$", 1)
    hours = F.regexp_extract(text, r"T.*([+-])(\d\d):?(\d\d)$", 2).try_cast("int")
    minutes = F.regexp_extract(text, r"T.*([+-])(\d\d):?(\d\d)$", 3).try_cast("int")
    ahead = F.coalesce(hours * 60 + minutes, F.lit(0)) * F.when(offset == "-", -1).otherwise(1)
    clock = _ntz(F.regexp_extract(text, r"^[^TZ]*(T\d\d:\d\d(:\d\d)?)?", 0))
    return F.timestamp_add("MINUTE", -ahead, clock).cast("date")


def date_key(day: Column) -> Column:
    """Date as the integer yyyymmdd."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def key_of_day_text(day: Column) -> Column:
    """Text ``yyyy-mm-dd`` as the integer yyyymmdd."""
    return F.replace(day, F.lit("-"), F.lit("")).cast("int")


def period_start(day: Column, grain: str) -> Column:
    """First day of the summary period; weeks begin on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}, expected one of {sorted(GRAINS)}")
    return day if grain == "daily" else F.trunc(day, GRAINS[grain])
