"""Report parameters and the normalisation of request values."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

# Platforms a report covers when none is asked for.
SCREEN_PLATFORMS = ("Web", "Mobile")
EXPORT_PLATFORMS = ("Web", "Mobile", "Connected")

# Sort field of a request -> column.
SORT_FIELDS = {
    "platform": "platform",
    "brand": "brand",
    "dateKey": "event_date",
    "series_name": "series_name",
    "title": "episode_name",
    "videoStarts": "content_starts",
    "video25Complete": "pct25_viewed",
    "video50Complete": "pct50_viewed",
    "video75Complete": "pct75_viewed",
    "video95Complete": "pct95_viewed",
    "videoCompletes": "pct100_viewed",
    "secondsWatched": "total_seconds_viewed",
    "downloads": "content_starts",
    "x1_user_type": "x1_user_type",
}


@dataclass(frozen=True)
class ReportParams:
    """What a report is asked for.

    ``None`` means "not asked for", so no filter; an empty list of brands is a
    filter that keeps nothing.
    """

    first_day: dt.date
    last_day: dt.date
    platforms: Sequence[str] | None = None
    brands: Sequence[str] | None = None
    series_title: str | None = None
    video_title: str | None = None
    product: str | None = None
    order_by: tuple[str, str] | None = None


def words(text: str | None) -> list[str]:
    """Items between blanks and commas."""
    return [item for item in re.split(r"[\s,]+", text or "") if item]


def platforms(text: str | None, default: Sequence[str]) -> list[str]:
    return words(text) or list(default)


def sort_key(order_by: str) -> tuple[str, str]:
    """``"videoStarts desc"`` -> column and direction."""
    field, _, direction = order_by.strip().partition(" ")
    if field not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {field!r}")
    direction = direction.strip().lower() or "asc"
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown sort direction {direction!r}")
    return SORT_FIELDS[field], direction


def days_from_text(start: str, end: str) -> tuple[dt.date, dt.date]:
    """First and last day of a request in ISO text.

    A start at the first and an end at the last second of a day name that day,
    whatever their offset. Other moments are taken in UTC, and such an end is
    exclusive: the last day is the one before.
    """
    first = _named_day(start) if "T00:00:00" in start else _utc_day(start)
    if "T23:59:59" in end:
        return first, _named_day(end)
    return first, _utc_day(end) - dt.timedelta(days=1)


def days_from_epoch_ms(
    start: int | str, end: int | str, exclusive_end: bool = True
) -> tuple[dt.date, dt.date]:
    """First and last day of a request in epoch milliseconds, in UTC.

    With ``exclusive_end`` an end that is not the last second of a day is
    exclusive; without, the day of the end is the last day.
    """
    first = dt.datetime.fromtimestamp(int(start) // 1000, dt.UTC)
    last = dt.datetime.fromtimestamp(int(end) // 1000, dt.UTC)
    shift = exclusive_end and f"{last:%H:%M:%S}" != "23:59:59"
    return first.date(), last.date() - dt.timedelta(days=1 if shift else 0)


def export_product(product: str | None) -> str | None:
    """Product name as exports spell it."""
    if product is not None and product.lower() == "nowtv":
        return "now tv"
    return product


def _named_day(text: str) -> dt.date:
    return dt.date.fromisoformat(text.partition("T")[0])


def _utc_day(text: str) -> dt.date:
    moment = dt.datetime.fromisoformat(text)
    return (moment.astimezone(dt.UTC) if moment.tzinfo else moment).date()
