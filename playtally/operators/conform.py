"""Raw playback events -> one conformed, de-duplicated, day-bucketed table."""

from __future__ import annotations

import datetime as dt
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions import (
    blank_to_na,
    completion_flags,
    event_day,
    local_day_start,
    platform_bucket,
    zero_if_blank,
)
from playtally.operators.stacking import stack

# Days of events and days of arrival keys that are looked back
# on, counted from the day before the run and from the run day itself.
EVENT_DAYS = 8
KEY_DAYS = 15


@dataclass(frozen=True)
class Branch:
    """One kind of playback: its label and where its columns come from."""

    content_type: str
    entity_type: str
    asset_key: str
    brand_column: str


# Content type, entity type, asset key and brand of each branch.
LIVE = Branch("Live", "Live", "program_id", "company")
ONDEMAND = Branch("OnDemand", "On-Demand", "media_guid", "provider")


def recent(*as_of: dt.date) -> Column:
    """Events of the eight days before one of the run days.

    The event day is local, so its bounds are turned into epoch milliseconds
    once. They fold to constants and prune row groups at the scan, and the
    arrival key - the partition column - prunes directories.
    """
    return reduce(operator.or_, [_recent(day) for day in as_of])


def _recent(as_of: dt.date) -> Column:
    first_day = as_of - dt.timedelta(days=EVENT_DAYS)
    first_key = as_of - dt.timedelta(days=KEY_DAYS)
    stamp = F.col("event_timestamp")
    return (
        (stamp >= local_day_start(first_day) * 1000)
        & (stamp < local_day_start(as_of) * 1000)
        & F.col("event_datekey").between(_key(first_key), _key(as_of))
    )


def not_yet_conformed(raw_events: DataFrame, as_of: dt.date, previous: dt.date) -> DataFrame:
    """Raw events of the window of ``as_of`` that the run of ``previous`` may have left out.

    That run saw all events of the arrival days before its own; of those, only
    event days from its own on were too young. What arrived on its day or later is read
    whole. The first part is pruned by row groups, the second by directories.
    """
    first_key, last_key = as_of - dt.timedelta(days=KEY_DAYS), as_of
    key, stamp = F.col("event_datekey"), F.col("event_timestamp")
    earlier = key.between(_key(first_key), _key(previous - dt.timedelta(days=1)))
    later = key.between(_key(max(first_key, previous)), _key(last_key))
    too_young = stamp >= local_day_start(previous) * 1000
    in_window = raw_events.where(recent(as_of))
    return in_window.where(later).unionByName(in_window.where(earlier & too_young))


def excluded_devices(filtered_devices: DataFrame) -> DataFrame:
    """Device and program pairs whose live viewing is not counted."""
    return filtered_devices.where(
        F.col("time_diff") & (F.col("program_count") > 3)
    ).select(
        F.col("device_id").cast("string"), F.col("program_id").cast("string")
    )


def conform(
    raw_events: DataFrame,
    assets: dict[Branch, DataFrame],
    as_of: dt.date,
    excluded_live: DataFrame | None = None,
) -> DataFrame:
    """Conformed events of the branches in ``assets``, 21 columns.

    ``excluded_live`` holds (device_id, program_id) pairs to leave out of live
    viewing.
    """
    return conform_selected(raw_events.where(recent(as_of)), assets, excluded_live)


def conform_selected(
    raw_events: DataFrame,
    assets: dict[Branch, DataFrame],
    excluded_live: DataFrame | None = None,
) -> DataFrame:
    """Conformed events of given raw events, whatever their days.

    Every branch reads its own rows and columns, so the filter on the entity type
    and the pruning of columns reach the scan. Where the assets are too many to
    broadcast, Spark builds a Bloom filter of the valid keys and tests it at the
    scan, before the first shuffle (``session.SETTINGS``). Only live rows with an asset
    are shuffled for the exclusion. One de-duplication serves all branches, which
    is exact because they differ in content type.
    """
    rows = []
    for branch, frame in assets.items():
        key = F.col(branch.asset_key).cast("string").alias("asset_key")
        is_own = F.col("entity_type") == branch.entity_type
        valid = frame.where(is_own & F.col("last_update").isNotNull()).select(key, "tms_episode_id")
        device = F.col("device_id").cast("string")
        events = raw_events.where(is_own).withColumn("device_id", device).withColumn("asset_key", key)
        events = events.join(valid, "asset_key")
        if branch == LIVE and excluded_live is not None:
            pairs = excluded_live.select("device_id", F.col("program_id").alias("asset_key"))
            events = events.join(pairs, ["device_id", "asset_key"], "left_anti")
        rows.append(events.select(*_conformed_columns(branch)))
    return stack(rows).distinct()


def conform_increment(
    raw_events: DataFrame,
    stored: DataFrame | None,
    assets: dict[Branch, DataFrame],
    as_of: dt.date,
    previous: dt.date | None,
    excluded_live: DataFrame | None = None,
) -> DataFrame:
    """Conformed events of a run day that other runs have not stored.

    ``stored`` holds what they conformed, ``previous`` is the last run day before
    this one. An event is conformed once: one that is stored under its arrival day is
    left out by its id, which concerns events that arrived on or after the day of
    the previous run; no other stored rows are read.
    """
    raw = raw_events.where(recent(as_of)) if previous is None else not_yet_conformed(raw_events, as_of, previous)
    rows = conform_selected(raw, assets, excluded_live)
    if stored is None:
        return rows
    first_key = as_of - dt.timedelta(days=KEY_DAYS) if previous is None else previous
    seen = stored.where(F.col("event_datekey").between(_key(first_key), _key(as_of)))
    keys = ["event_datekey", "event_id"]
    return rows.join(seen.select(*keys), keys, "left_anti").select(*rows.columns)


def merge_events(
    raw_events: DataFrame,
    live_assets: DataFrame,
    ondemand_assets: DataFrame,
    filtered_devices: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """Conformed events of live and on-demand playback."""
    return conform(
        raw_events,
        {LIVE: live_assets, ONDEMAND: ondemand_assets},
        as_of,
        excluded_devices(filtered_devices),
    )


def _conformed_columns(branch: Branch) -> list[Column]:
    flags = completion_flags(F.col("duration_secs"), F.col("viewed_secs"))
    return [
        F.lit(branch.content_type).alias("content_type"),
        event_day(F.col("event_timestamp")).alias("eventdate"),
        F.col("event_datekey"),
        platform_bucket(F.col("platform")).alias("platform"),
        blank_to_na(F.col(branch.brand_column)).alias("brand"),
        blank_to_na(F.col("series_name")).alias("series_title"),
        blank_to_na(F.col("season_number")).alias("season_number"),
        blank_to_na(F.col("episode_number")).alias("episode_number"),
        blank_to_na(F.col("episode_name")).alias("episode_name"),
        blank_to_na(F.col("tms_episode_id")).alias("gracenote_id"),
        F.col("airdate"),
        F.col("event_id"),
        F.col("device_id"),
        zero_if_blank(F.col("duration_secs")).alias("duration_secs"),
        zero_if_blank(F.col("viewed_secs")).alias("viewed_secs"),
        *[flag.alias(name) for name, flag in flags.items()],
        F.col("x1_user_type"),
    ]


def _key(day: dt.date) -> int:
    return int(f"{day:%Y%m%d}")
