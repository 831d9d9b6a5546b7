import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally.operators import conform, rollup
from playtally.params import ReportParams
from playtally.plans import pipeline, reports
from playtally.sources import star_schema, tables
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"


def _same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_summaries_of_part_of_the_days_replace_their_periods(spark, tmp_path):
    root = str(tmp_path)
    plays = rollup.plays_from_viewing(star_schema.viewing(spark, FOLDER)).where(
        F.year("event_date") == 1998
    )
    year = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    pipeline.build_summaries(plays, root, *year)
    for grain in ("daily", "weekly", "monthly"):
        stored = spark.read.parquet(f"{root}/summary_{grain}")
        assert _same(stored, rollup.roll_up(plays, grain))
    # Late plays of some days: their week and month change, nothing else does.
    days = dt.date(1998, 3, 4), dt.date(1998, 3, 10)
    more = plays.unionByName(
        plays.where(F.col("event_date").between(*days)).withColumn(
            "device_id", F.concat(F.lit("late"), "device_id")
        )
    )
    pipeline.build_summaries(more, root, *days)
    for grain in ("daily", "weekly", "monthly"):
        stored = spark.read.parquet(f"{root}/summary_{grain}")
        assert _same(stored, rollup.roll_up(more, grain))


def test_withdrawn_days_disappear(spark, tmp_path):
    root = str(tmp_path)
    days = dt.date(1998, 3, 2), dt.date(1998, 3, 15)
    plays = rollup.plays_from_viewing(star_schema.viewing(spark, FOLDER)).where(
        F.col("event_date").between(*days)
    )
    pipeline.build_summaries(plays, root, *days)
    # One week and one day of the next have no plays any more.
    left = plays.where(F.col("event_date") > dt.date(1998, 3, 9))
    assert 0 < left.count() < plays.count()
    pipeline.build_summaries(left, root, *days)
    for grain in ("daily", "weekly", "monthly"):
        assert _same(tables.read_table(spark, root, f"summary_{grain}"), rollup.roll_up(left, grain))
    pipeline.build_summaries(left.limit(0), root, *days)
    assert tables.read_table(spark, root, "summary_daily").isEmpty()


def _write_raw(spark, root, arrived=None):
    for name in ("raw_events", "live_assets", "ondemand_assets", "live_filtered_devices"):
        frame = getattr(star_schema, name)(spark, FOLDER)
        if name == "raw_events" and arrived is not None:
            frame = frame.where(arrived)
        tables.write_table(frame, f"{root}/{name}", tables.PARTITION_COLUMN.get(name), mode="overwrite")


def _conformed(spark, root, *run_days):
    names = ["raw_events", "live_assets", "ondemand_assets", "live_filtered_devices"]
    raw, live, ondemand, devices = (tables.read_table(spark, root, name) for name in names)
    return conform.conform_selected(
        raw.where(conform.recent(*run_days)),
        {conform.LIVE: live, conform.ONDEMAND: ondemand},
        conform.excluded_devices(devices),
    )


def test_run_days_add_what_others_have_not_stored(spark, tmp_path):
    root, second = str(tmp_path), star_schema.AS_OF
    first = second - dt.timedelta(days=2)
    key = int(f"{first:%Y%m%d}")
    # The first run finds half of what arrives on its day.
    arrived = (F.col("event_datekey") < key) | ((F.col("event_datekey") == key) & (F.col("event_id") % 4 < 2))
    _write_raw(spark, root, arrived)
    pipeline.materialise_events(spark, root, first)
    _write_raw(spark, root)
    for _ in range(2):
        pipeline.materialise_events(spark, root, second)
        stored = tables.read_table(spark, root, "merged_events")
        own = stored.where(F.col("run_day") == second)
        assert 0 < own.count() < stored.count() == stored.select("event_id").distinct().count()
        # One run over all days, of which the first one could not see what came late and is too old by now.
        late = (F.col("event_datekey") == key) & (F.col("event_id") % 4 >= 2)
        too_old = late & (F.col("eventdate") < second - dt.timedelta(days=conform.EVENT_DAYS))
        assert _same(stored.drop("run_day"), _conformed(spark, root, first, second).where(~too_old))
    # A repeated first run takes nothing that the second has.
    pipeline.materialise_events(spark, root, first)
    stored = tables.read_table(spark, root, "merged_events")
    assert _same(stored.drop("run_day"), _conformed(spark, root, first, second))
    events = pipeline.stored_events(spark, root, second)
    assert _same(events.drop("run_day"), _conformed(spark, root, second))
    assert pipeline.stored_events(spark, root, first).where(F.col("run_day") > first).isEmpty()


def test_a_run_reads_only_arrival_days_that_are_open(spark, tmp_path):
    root, as_of = str(tmp_path), star_schema.AS_OF
    _write_raw(spark, root)
    raw = tables.read_table(spark, root, "raw_events")
    plan = plan_of(conform.not_yet_conformed(raw, as_of, as_of - dt.timedelta(days=1)))
    later, earlier = (b for b in plan.split("\n\n") if "PartitionFilters" in b)
    assert "20240115" in later.split("PartitionFilters")[1].split("\n")[0]
    assert "event_timestamp" in earlier.split("PushedFilters")[1].split("\n")[0]


def test_large_tables_are_not_read_over_jdbc_by_one_task(spark):
    with pytest.raises(ValueError, match="lowerBound, upperBound, numPartitions"):
        tables.read_jdbc(spark, "t", "jdbc:none", partitionColumn="id")


def test_touched_periods_prune_directories(spark, tmp_path):
    plays = rollup.plays_from_viewing(star_schema.viewing(spark, FOLDER)).where(
        F.year("event_date") == 1998
    )
    day = dt.date(1998, 5, 6)
    pipeline.build_summaries(plays, str(tmp_path), day, day)
    stored = spark.read.parquet(f"{tmp_path}/device_days")
    month = stored.where(pipeline._in_touched_periods("monthly", day, day))
    scan = next(b for b in plan_of(month).split("\n\n") if "device_days" in b)
    filters = scan.split("PartitionFilters")[1].split("\n")[0]
    assert "1998-05-01" in filters and "1998-06-01" in filters


def test_daily_run_from_raw_events_to_a_report(spark, tmp_path):
    root = str(tmp_path)
    _write_raw(spark, root)
    for days in (1, 0):
        pipeline.daily_run(spark, root, star_schema.AS_OF - dt.timedelta(days=days))
    merged = tables.read_table(spark, root, "merged_events")
    assert merged.select("run_day").distinct().count() == 2
    for grain in ("daily", "weekly", "monthly"):
        summary = tables.read_table(spark, root, f"event_summary_{grain}")
        assert _same(summary, rollup.roll_up(rollup.plays_from_events(merged), grain))
    assets = pipeline.event_assets(spark, root)
    assert assets.count() == merged.select(*rollup.ASSET_NAMES).distinct().count()
    weekly = tables.read_table(spark, root, "event_summary_weekly")
    report = reports.export(
        reports.LIVE_UNIQUE_WEEKLY, weekly, assets,
        ReportParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
    )
    live = weekly.where("content_type = 'Live' AND gracenote_id IS NOT NULL")
    assert report.agg(F.sum("unique_devices")).first()[0] == (
        live.agg(F.sum("unique_devices")).first()[0]
    )
    assert {r.series_name for r in report.collect()} <= {"Ser", "N/A"}
