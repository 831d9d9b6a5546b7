"""One key holds a third of all rows and nothing is broadcast."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playtally.operators import conform, membership, paging
from playtally.params import ReportParams
from playtally.plans import entitlements, reports
from playtally.sources.schemas import schema
from tests.conftest import final_plan_of

N = 60_000
AS_OF = dt.date(2024, 1, 16)
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    # So few bytes would be coalesced into one map task, which cannot be split.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@pytest.fixture(autouse=True)
def skew_settings(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


def _rows(spark):
    """Ids with a key that is 0 for a third of them."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)
    return spark.range(0, N, 1, 8).withColumn("key", hot)


def test_hot_program_is_split(spark):
    raw = _rows(spark).select(
        F.col("id").alias("event_id"),
        (F.lit(1_705_060_800_000) + F.col("id")).alias("event_timestamp"),
        F.lit(20240112).alias("event_datekey"),
        F.lit("ios").alias("platform"),
        F.lit("Live").alias("entity_type"),
        F.col("key").cast("string").alias("program_id"),
        F.concat(F.lit("d"), F.col("id") % 1000).alias("device_id"),
        F.lit("B").alias("company"),
        *[F.lit("x").alias(c) for c in
          ("series_name", "season_number", "episode_number", "episode_name", "airdate")],
        F.lit(400).cast("long").alias("duration_secs"),
        F.col("id").alias("viewed_secs"),
        F.lit(None).cast("string").alias("x1_user_type"),
    )
    assets = spark.range(97).select(
        F.col("id").cast("string").alias("program_id"), F.lit("Live").alias("entity_type"),
        F.lit("EP").alias("tms_episode_id"), F.lit("x").alias("last_update"),
    )
    filtered = spark.createDataFrame(
        [("d0", "0", True, 4), ("d3", "0", True, 4)], schema("live_filtered_devices")
    )
    live = conform.conform(
        raw, {conform.LIVE: assets}, AS_OF, conform.excluded_devices(filtered)
    )
    assert "skew=true" in final_plan_of(live)
    dropped = raw.where("program_id = '0' AND device_id IN ('d0', 'd3')").count()
    assert dropped > 0
    assert live.count() == N - dropped


def test_hot_asset_is_split(spark):
    summary = _rows(spark).select(
        F.lit(dt.date(2024, 1, 1)).alias("event_date"),
        F.col("key").alias("asset_id"),
        F.lit("Web").alias("platform"), F.lit("B").alias("brand"),
        F.lit("OnDemand").alias("content_type"),
        F.col("id").cast("string").alias("x1_user_type"),
        F.lit(None).cast("string").alias("gracenote_id"),
        *[F.lit(1).cast("long").alias(c) for c in
          ("content_starts", "pct25_viewed", "pct50_viewed", "pct75_viewed", "pct95_viewed",
           "pct100_viewed", "total_seconds_viewed")],
    )
    assets = spark.range(97).select(
        F.col("id").alias("asset_id"), F.lit("B").alias("brand"),
        *[F.concat(F.lit("t"), F.col("id")).alias(c) for c in
          ("series_name", "episode_name", "episode_number", "season_number", "program_type",
           "rating", "available_date", "expiration_date")],
    )
    day = dt.date(2024, 1, 1)
    table = reports.performance(summary, assets, ReportParams(day, day))
    assert "skew=true" in final_plan_of(table)
    assert table.agg(F.sum("content_starts")).first()[0] == N


def test_hot_group_is_split(spark):
    users_groups = _rows(spark).select(F.col("id").alias("user_id"), F.col("key").alias("group_id"))
    groups_brands = spark.range(97).select(
        F.col("id").alias("group_id"), (F.col("id") % 5).alias("brand_id")
    )
    brands = spark.range(5).select(
        F.col("id").alias("brand_id"), F.lit("n").alias("name"), F.lit("Live").alias("content_type")
    )
    nobody = spark.createDataFrame([], schema("users_brands"))
    entitled = entitlements.entitled_brands(nobody, users_groups, groups_brands, brands)
    assert "skew=true" in final_plan_of(entitled)
    assert entitled.count() == N


def test_copies_of_one_link_collapse_before_the_shuffle(spark):
    """A third of the current links are copies of one."""
    current = _rows(spark).select(
        F.when(F.col("key") == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.col("key").alias("brand_id"),
    )
    desired = current.where("user_id % 2 = 0")
    diff = membership.membership_diff(current, desired, "user_id", "brand_id")
    expected = current.where("user_id % 2 = 1").distinct().count()
    plan = final_plan_of(diff)
    assert diff.count() == expected
    # Aggregation on the map side, one shuffle, aggregation on the other.
    assert plan.split("Initial Plan")[0].count("ShuffleQueryStage") == 1


def test_output_of_a_hot_brand_is_sorted_by_many_tasks(spark):
    """Rows that tie in the sort keys still spread over sorted partitions."""
    df = _rows(spark).select(
        F.lit("B").alias("brand"), F.lit("Live").alias("content_type"),
        F.lit("Web").alias("platform"), F.lit(dt.date(2024, 1, 1)).alias("event_date"), "id",
    )
    ordered = paging.ordered(df, reports.EXPORT_ORDER)
    rows = ordered.select("id", F.spark_partition_id().alias("part")).collect()
    assert [r.id for r in rows] == list(range(N))
    sizes = Counter(r.part for r in rows)
    assert len(sizes) > 4
    assert max(sizes.values()) < N / 3
