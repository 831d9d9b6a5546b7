import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally.operators import rollup
from playtally.sources import star_schema
from tests.conftest import final_plan_of, plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plays(spark):
    return rollup.plays_from_viewing(star_schema.viewing(spark, FOLDER)).cache()


def _viewing(spark, rows):
    df = spark.createDataFrame(
        rows, "event_date date, asset_id bigint, device_id string, duration_secs bigint,"
        " viewed_secs bigint"
    )
    constants = {
        "platform": "Web", "brand": "B", "content_type": "Live", "x1_user_type": None,
        "gracenote_id": None, "air_date": "2024",
    }
    return df.withColumns({k: F.lit(v).cast("string") for k, v in constants.items()})


def test_devices_are_counted_again_at_each_grain(spark):
    mon, tue, next_mon = dt.date(2024, 1, 29), dt.date(2024, 1, 30), dt.date(2024, 2, 5)
    plays = rollup.plays_from_viewing(_viewing(spark, [
        (mon, 1, "a", 100, 30), (mon, 1, "a", 100, 100), (mon, 1, "b", 100, 10),
        (tue, 1, "a", 200, None), (next_mon, 1, "a", None, 5), (next_mon, 1, None, 100, 100),
    ]))
    days = {r.event_date: r for r in rollup.roll_up(plays, "daily").collect()}
    assert (days[mon].content_starts, days[mon].unique_devices) == (3, 2)
    assert (days[mon].pct25_viewed, days[mon].pct100_viewed) == (2, 1)
    assert (days[mon].total_seconds_viewed, days[mon].total_duration) == (140, 100)
    assert days[next_mon].unique_devices == 1
    weeks = {r.event_date: r for r in rollup.roll_up(plays, "weekly").collect()}
    assert set(weeks) == {mon, next_mon}
    assert (weeks[mon].unique_devices, weeks[mon].content_starts) == (2, 4)
    assert weeks[mon].total_duration == 200
    months = {r.event_date: r for r in rollup.roll_up(plays, "monthly").collect()}
    assert {d: r.unique_devices for d, r in months.items()} == {
        dt.date(2024, 1, 1): 2, dt.date(2024, 2, 1): 1
    }


@pytest.mark.parametrize("grain", ["daily", "weekly", "monthly"])
def test_device_days_give_the_same_summary(plays, grain):
    direct = rollup.roll_up(plays, grain)
    derived = rollup.roll_up_device_days(rollup.device_days(plays), grain)
    assert direct.exceptAll(derived).count() == 0
    assert derived.exceptAll(direct).count() == 0


def test_daily_summary_of_device_days_needs_no_distinct(spark, plays, tmp_path):
    rollup.device_days(plays).write.parquet(str(tmp_path / "device_days"))
    stored = spark.read.parquet(str(tmp_path / "device_days"))
    plan = plan_of(rollup.roll_up_device_days(stored, "daily"))
    assert plan.count("\n+- Exchange") + plan.count("Exchange (") >= 1
    assert "distinct" not in plan


def test_aggregation_hashes(plays):
    for summary in (rollup.roll_up(plays, "weekly"), rollup.device_days(plays)):
        assert "SortAggregate" not in plan_of(summary)


def test_approximate_devices_are_close(spark):
    day = dt.date(2024, 1, 1)
    rows = spark.range(20_000).select(F.lit(day).alias("event_date"), "id")
    viewing = rows.select(
        "event_date", F.lit(1).cast("long").alias("asset_id"),
        F.col("id").cast("string").alias("device_id"),
        F.lit(100).cast("long").alias("duration_secs"), F.lit(1).cast("long").alias("viewed_secs"),
        *[F.lit(None).cast("string").alias(c) for c in
          ("platform", "brand", "content_type", "x1_user_type", "gracenote_id", "air_date")],
    )
    plays = rollup.plays_from_viewing(viewing)
    exact = rollup.roll_up(plays, "daily").first().unique_devices
    close = rollup.roll_up(plays, "daily", approximate=True).first().unique_devices
    assert exact == 20_000
    assert abs(close - exact) < 0.15 * exact


def test_sketches_of_days_merge(spark):
    """Half of the devices come back on the second day."""
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    plays = spark.range(20_000).select(
        F.lit(first).alias("event_date"), F.lit("B").alias("brand"),
        F.col("id").cast("string").alias("device_id"),
    ).unionByName(
        spark.range(10_000, 30_000).select(
            F.lit(second).alias("event_date"), F.lit("B").alias("brand"),
            F.col("id").cast("string").alias("device_id"),
        )
    )
    sketches = rollup.device_sketches(plays, ["brand"])
    assert sketches.count() == 2
    [week] = rollup.devices_from_sketches(sketches, "weekly", ["brand"]).collect()
    assert week.event_date == first
    assert abs(week.unique_devices - 30_000) < 0.05 * 30_000


def test_weekly_devices_lie_between_the_days(plays):
    week = F.trunc("event_date", "WEEK")
    keys = [k for k in rollup.SUMMARY_KEYS if k != "event_date"]
    daily = (
        rollup.roll_up(plays, "daily")
        .groupBy(week.alias("event_date"), *keys)
        .agg(F.sum("unique_devices").alias("total"), F.max("unique_devices").alias("highest"))
    )
    weekly = rollup.roll_up(plays, "weekly").alias("w")
    on = [F.col(f"w.{k}").eqNullSafe(daily[k]) for k in rollup.SUMMARY_KEYS]
    joined = weekly.join(daily, on)
    assert joined.count() == weekly.count()
    devices = F.col("unique_devices")
    assert joined.where((devices > F.col("total")) | (devices < F.col("highest"))).count() == 0


def test_flags_are_monotone(plays):
    shares = [f"pct{s}_viewed" for s in (25, 50, 75, 95, 100)]
    broken = [F.col(a) < F.col(b) for a, b in zip(shares, shares[1:], strict=False)]
    for test in broken:
        assert rollup.roll_up(plays, "daily").where(test).count() == 0


def test_a_hot_asset_is_counted_by_many_tasks(spark):
    """All rows have one key: the devices still spread over the first shuffle."""
    day = dt.date(2024, 1, 1)
    viewing = _viewing(spark, [(day, 1, str(i % 500), 100, 50) for i in range(2000)])
    summary = rollup.roll_up(rollup.plays_from_viewing(viewing), "daily")
    plan = plan_of(summary)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(exchanges) == 2
    assert "device_id" in exchanges[0]
    assert "device_id" not in exchanges[1]
    assert summary.first().unique_devices == 500
    assert "SortAggregate" not in final_plan_of(summary)


def test_names_have_keys_of_their_own(spark):
    rows = [("a", "1:b", "", "", ""), ("a1", ":b", None, "", ""), ("a", "1:b", None, "N/A", "x"), ("a", None, "1:b", "", "")]
    names = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in rollup.ASSET_NAMES))
    keys = [r[0] for r in names.select(rollup.asset_key()).collect()]
    assert len(set(keys)) == len(keys) and {len(key) for key in keys} == {32}
    assets = rollup.assets_from_events(names.unionByName(names)).collect()
    assert sorted(r.asset_id for r in assets) == sorted(keys)


def test_a_key_of_two_assets_fails_the_job(spark):
    named = spark.createDataFrame(
        [("k", "A", "x"), ("k", "A", "x"), ("l", "B", "y")], "asset_id string, brand string, series_name string"
    )
    assert rollup.one_name_per_key(named).count() == 2
    clash = named.unionByName(named.withColumn("series_name", F.lit("z")))
    for job in (lambda df: df.collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="two assets have the key"):
            job(rollup.one_name_per_key(clash))
