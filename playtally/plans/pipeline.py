"""Jobs that keep the stored tables up to date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.functions import period_start
from playtally.functions.time import GRAINS
from playtally.operators.conform import (
    EVENT_DAYS,
    KEY_DAYS,
    LIVE,
    ONDEMAND,
    conform_increment,
    excluded_devices,
)
from playtally.operators.rollup import (
    asset_key,
    assets_from_events,
    device_days,
    plays_from_events,
    roll_up_device_days,
)
from playtally.sources.schemas import schema
from playtally.sources.tables import partition_values, read_table, replace_partitions


#: Columns that stored events are partitioned by: the arrival day, and the run that conformed them.
EVENT_PARTITIONS = ["event_datekey", "run_day"]


def materialise_events(spark: SparkSession, root: str, as_of: dt.date) -> str:
    """Add the events that a run day conforms to the stored ones, and return their path.

    A run reads the arrival days that earlier runs have not seen whole, and stores an
    event that no other run has stored. Its rows lie in partitions of their own,
    so a repeated run replaces what it wrote and nothing else.
    """
    path = f"{root}/merged_events"
    others = {x for x in partition_values(spark, path, EVENT_PARTITIONS) if x != as_of.isoformat()}
    earlier = [x for x in others if x < as_of.isoformat()]
    stored = None
    if others:
        stored = read_table(spark, root, "merged_events").where(F.col("run_day") != as_of)
    new = conform_increment(
        read_table(spark, root, "raw_events"),
        stored,
        {
            LIVE: read_table(spark, root, "live_assets"),
            ONDEMAND: read_table(spark, root, "ondemand_assets"),
        },
        as_of,
        dt.date.fromisoformat(max(earlier)) if earlier else None,
        excluded_devices(read_table(spark, root, "live_filtered_devices")),
    )
    rows = new.withColumn("run_day", F.lit(as_of))
    replace_partitions(rows, path, EVENT_PARTITIONS, lambda day: day == as_of.isoformat())
    return path


def stored_events(spark: SparkSession, root: str, as_of: dt.date) -> DataFrame:
    """Stored events of the event days that a run day looks back on, of all runs up to it.

    A run that stored such an event was at most seven days before, and looked back
    fifteen arrival days itself, which prunes directories.
    """
    first_key = as_of - dt.timedelta(days=KEY_DAYS + EVENT_DAYS - 1)
    first, last = as_of - dt.timedelta(days=EVENT_DAYS), as_of - dt.timedelta(days=1)
    return read_table(spark, root, "merged_events").where(
        (F.col("event_datekey") >= int(f"{first_key:%Y%m%d}"))
        & (F.col("run_day") <= as_of)
        & F.col("eventdate").between(first, last)
    )


def build_summaries(
    plays: DataFrame, root: str, first_day: dt.date, last_day: dt.date, kind: str = ""
) -> None:
    """Replace the device days of the given days, and the periods they touch.

    ``kind`` stands before the names of the tables: ``event_`` for those that have
    the asset keys of conformed events.

    The plays are read once. Device days are a stored table, so a lost executor
    costs no second pass over the plays, and the devices of a week or month
    are counted exactly without the plays of its other days. Days and periods
    without plays any more disappear.
    """
    spark = plays.sparkSession
    path = f"{root}/{kind}device_days"
    changed = device_days(plays.where(F.col("event_date").between(first_day, last_day)))
    replace_partitions(changed, path, "event_date", _between(first_day, last_day))
    stored = spark.read.schema(changed.schema).parquet(path)
    for grain in GRAINS:
        periods = stored.where(_in_touched_periods(grain, first_day, last_day))
        replace_partitions(
            roll_up_device_days(periods, grain),
            f"{root}/{kind}summary_{grain}",
            "event_date",
            _between(_start(first_day, grain), last_day),
        )


def _between(first_day: dt.date, last_day: dt.date) -> Callable[[str], bool]:
    return lambda day: first_day.isoformat() <= day <= last_day.isoformat()


def _start(day: dt.date, grain: str) -> dt.date:
    """First day of the period that a day lies in."""
    back = {"daily": 0, "weekly": day.weekday(), "monthly": day.day - 1}[grain]
    return day - dt.timedelta(days=back)


def daily_run(spark: SparkSession, root: str, as_of: dt.date) -> None:
    """Conform a run day's events and bring their summaries and assets up to date."""
    materialise_events(spark, root, as_of)
    days = as_of - dt.timedelta(days=EVENT_DAYS), as_of - dt.timedelta(days=1)
    events = stored_events(spark, root, as_of)
    build_summaries(plays_from_events(events), root, *days, kind="event_")
    names = schema("event_assets").names
    assets = events.select(
        F.col("eventdate").alias("event_date"), F.col("series_title").alias("series_name"),
        *[c for c in names if c in events.columns], asset_key().alias("asset_id"),
    ).select(*names).distinct()
    replace_partitions(assets, f"{root}/event_assets", "event_date", _between(*days))


def event_assets(spark: SparkSession, root: str) -> DataFrame:
    """Assets of the stored events, one row per key, for reports over their summaries."""
    stored = read_table(spark, root, "event_assets").withColumnRenamed("series_name", "series_title")
    return assets_from_events(stored)


def _in_touched_periods(grain: str, first_day: dt.date, last_day: dt.date) -> Column:
    """Days of the whole periods that the given days lie in."""
    day = F.col("event_date")
    start = period_start(F.lit(first_day), grain)
    last_start = period_start(F.lit(last_day), grain)
    end = {
        "daily": F.date_add(last_start, 1),
        "weekly": F.date_add(last_start, 7),
        "monthly": F.add_months(last_start, 1),
    }[grain]
    return (day >= start) & (day < end)
