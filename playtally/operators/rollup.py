"""Daily, weekly and monthly summaries of plays.

A play is one playback with an ``asset_id``. Unique devices do not add up over
days, so each grain counts them from plays, or from device days: a mergeable
intermediate with one row per summary row, day and device, from which all
three grains are derived without reading the plays again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions import blank_to_na, completion_flags, na_to_null, period_start
from playtally.functions.metrics import COMPLETION_SHARES
from playtally.functions.time import GRAINS
from playtally.operators.stacking import stack

SUMMARY_KEYS = [
    "event_date",
    "asset_id",
    "platform",
    "brand",
    "content_type",
    "x1_user_type",
    "gracenote_id",
    # An attribute of the asset rather than a dimension. It is a key because a
    # text in an aggregation buffer makes Spark sort where it could hash.
    "air_date",
]

ADDITIVE_METRICS = [
    "content_starts",
    "pct25_viewed",
    "pct50_viewed",
    "pct75_viewed",
    "pct95_viewed",
    "pct100_viewed",
    "total_seconds_viewed",
]

# What names an asset in conformed events.
ASSET_NAMES = ["brand", "series_title", "season_number", "episode_number", "episode_name"]

# Relative standard error of the approximate device count. A smaller one costs
# more memory per summary row while it is aggregated.
APPROXIMATE_ERROR = 0.05

# Log2 of the slots of a device sketch: an error of about 1 % in 4 KB.
SKETCH_BITS = 13


def plays_from_viewing(viewing: DataFrame) -> DataFrame:
    """Add completion flags and metrics to viewing rows with an ``asset_id``."""
    flags = completion_flags(F.col("duration_secs"), F.col("viewed_secs"))
    return viewing.select(
        *SUMMARY_KEYS,
        "device_id",
        F.coalesce("duration_secs", F.lit(0)).cast("long").alias("total_duration"),
        F.lit(1).cast("long").alias("content_starts"),
        *[flag.cast("long").alias(name) for name, flag in flags.items()],
        F.coalesce("viewed_secs", F.lit(0)).cast("long").alias("total_seconds_viewed"),
    )


def asset_key() -> Column:
    """Key of the asset of a conformed event: a 128-bit digest of what names it, as 32 hex digits.

    Every name stands behind its length, so different lists of names have different texts.
    """
    names = [blank_to_na(F.col(name)) for name in ASSET_NAMES]
    parts = [F.concat(F.length(name).cast("string"), F.lit(":"), name) for name in names]
    return F.md5(F.concat(*parts))


def assets_from_events(merged_events: DataFrame) -> DataFrame:
    """One row per asset of conformed events: its key and names, and nulls for what events do not tell."""
    names = merged_events.select(*[blank_to_na(F.col(name)).alias(name) for name in ASSET_NAMES]).distinct()
    named = names.withColumn("asset_id", asset_key()).withColumnRenamed("series_title", "series_name")
    return one_name_per_key(named).select(
        "*",
        *[
            F.lit(None).cast("string").alias(column)
            for column in ("program_type", "rating", "available_date", "expiration_date")
        ],
    )


def one_name_per_key(named: DataFrame) -> DataFrame:
    """The rows, one per ``asset_id``; a key with two names fails the job instead of mixing two assets."""
    names = [c for c in named.columns if c != "asset_id"]
    found = named.groupBy("asset_id").agg(
        F.min(F.struct(*names)).alias("low"), F.max(F.struct(*names)).alias("high")
    )
    message = F.concat(F.lit("two assets have the key "), F.col("asset_id"))
    is_one = F.assert_true(F.col("low") == F.col("high"), message).isNull()
    # In a filter, the test cannot be pruned with the columns that it compares.
    return found.where(is_one).select("asset_id", "low.*")


def plays_from_events(merged_events: DataFrame) -> DataFrame:
    """Plays of conformed events; the placeholder episode id becomes null again."""
    return merged_events.select(
        F.col("eventdate").alias("event_date"),
        asset_key().alias("asset_id"),
        "platform",
        "brand",
        "content_type",
        "x1_user_type",
        na_to_null(F.col("gracenote_id")).alias("gracenote_id"),
        F.col("airdate").alias("air_date"),
        "device_id",
        F.col("duration_secs").alias("total_duration"),
        F.lit(1).cast("long").alias("content_starts"),
        *[
            F.col(f"pct{share}_viewed").cast("long").alias(f"pct{share}_viewed")
            for share in COMPLETION_SHARES
        ],
        F.col("viewed_secs").alias("total_seconds_viewed"),
    )


def roll_up(plays: DataFrame, grain: str, approximate: bool = False) -> DataFrame:
    """Summary of one grain straight from plays; ``event_date`` starts the period.

    The exact count first spreads rows over (keys, device) and then over the
    keys, both times after combining on the map side, so that a popular asset
    is never counted in one task.
    """
    return _summarise(_on_period(plays, grain), _devices(approximate))


def device_days(plays: DataFrame) -> DataFrame:
    """One row per summary row, day and device; write it once, derive all grains."""
    return plays.groupBy(*SUMMARY_KEYS, "device_id").agg(*_measures())


def roll_up_device_days(
    device_days: DataFrame, grain: str, approximate: bool = False
) -> DataFrame:
    """Summary of one grain from device days.

    A day has one row per device already, so the daily count needs no
    distinct and with it one shuffle less.
    """
    if grain == "daily":
        return _summarise(device_days, F.count("device_id"))
    return _summarise(_on_period(device_days, grain), _devices(approximate))


def unique_devices(
    plays: DataFrame, by: list[str], grains: Sequence[str] = tuple(GRAINS)
) -> DataFrame:
    """De-duplicated devices per grain, period and ``by``.

    All grains count the same device days, so Spark computes those once and
    reuses the exchange.
    """
    days = plays.select("event_date", *by, "device_id").distinct()
    return stack(
        [
            _on_period(days, grain)
            .groupBy("event_date", *by)
            .agg(F.countDistinct("device_id").alias("unique_devices"))
            .select(F.lit(grain).alias("grain"), "event_date", *by, "unique_devices")
            for grain in grains
        ]
    )


def device_sketches(plays: DataFrame, by: list[str]) -> DataFrame:
    """One mergeable sketch of devices per day and ``by``.

    For readers that want unique devices of any span of days from a table of
    the size of the daily summary, at a relative error of about one percent.
    """
    return plays.groupBy("event_date", *by).agg(
        F.hll_sketch_agg("device_id", SKETCH_BITS).alias("device_sketch")
    )


def devices_from_sketches(sketches: DataFrame, grain: str, by: list[str]) -> DataFrame:
    """Estimated devices per period and ``by`` from the sketches of its days."""
    return (
        _on_period(sketches, grain)
        .groupBy("event_date", *by)
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("device_sketch")).alias("unique_devices")
        )
    )


def _on_period(df: DataFrame, grain: str) -> DataFrame:
    return df.withColumn("event_date", period_start(F.col("event_date"), grain))


def _devices(approximate: bool) -> Column:
    if approximate:
        return F.approx_count_distinct("device_id", APPROXIMATE_ERROR)
    return F.countDistinct("device_id")


def _measures() -> list[Column]:
    return [
        F.max("total_duration").alias("total_duration"),
        *[F.sum(name).alias(name) for name in ADDITIVE_METRICS],
    ]


def _summarise(df: DataFrame, devices: Column) -> DataFrame:
    return df.groupBy(*SUMMARY_KEYS).agg(
        *_measures(), devices.cast("long").alias("unique_devices")
    )
