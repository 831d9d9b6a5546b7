import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally.operators import conform
from playtally.sources import star_schema, tables
from playtally.sources.schemas import schema
from tests.conftest import plan_of

AS_OF = dt.date(2024, 1, 16)


def _ms(text):
    """Epoch milliseconds of a UTC time."""
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp() * 1000)


def _event(event_id, **changes):
    row = {
        "event_id": event_id, "event_timestamp": _ms("2024-01-12 12:00:00"),
        "event_datekey": 20240112, "platform": "ios", "entity_type": "Live",
        "program_id": "p1", "media_guid": None, "device_id": "d1", "company": "Acme",
        "provider": "Prov", "series_name": "", "season_number": None, "episode_number": "1",
        "episode_name": "Ep", "airdate": "2024-01-01", "duration_secs": 400,
        "viewed_secs": 101, "x1_user_type": None,
    }
    return {**row, **changes}


@pytest.fixture(scope="module")
def dims(spark):
    live = spark.createDataFrame(
        [("p1", "Live", "EP1", "x"), ("p2", "Live", "", "x"), ("p3", "Live", "EP3", None),
         ("p4", "On-Demand", "EP4", "x")],
        schema("live_assets"),
    )
    ondemand = spark.createDataFrame(
        [("m1", "On-Demand", "EP9", "x"), ("m1", "On-Demand", "EP9", "y")],
        schema("ondemand_assets"),
    )
    filtered = spark.createDataFrame(
        [("d2", "p1", True, 4), ("d3", "p1", True, 3), ("d4", "p1", False, 9),
         ("d2", "p1", True, 8), (None, "p1", True, 9), ("d5", "p1", None, 9)],
        schema("live_filtered_devices"),
    )
    return live, ondemand, filtered


def _merged(spark, dims, events):
    raw = spark.createDataFrame(
        [[e[f.name] for f in schema("raw_events")] for e in events], schema("raw_events")
    )
    return conform.merge_events(raw, *dims, AS_OF)


def test_schema(spark, dims):
    merged = _merged(spark, dims, [_event(1)])
    assert [(f.name, f.dataType) for f in merged.schema] == [
        (f.name, f.dataType) for f in schema("merged_events") if f.name != "run_day"
    ]


def test_labels_defaults_and_brand_source(spark, dims):
    live, ondemand = sorted(
        _merged(spark, dims, [
            _event(1, company=None, program_id="p2", viewed_secs=None),
            _event(2, entity_type="On-Demand", media_guid="m1", platform="roku"),
        ]).collect(),
        key=lambda r: r.event_id,
    )
    assert (live.content_type, live.brand, live.gracenote_id) == ("Live", "N/A", "N/A")
    assert (live.series_title, live.season_number, live.viewed_secs) == ("N/A", "N/A", 0)
    assert live.eventdate == dt.date(2024, 1, 12)
    assert (ondemand.content_type, ondemand.brand, ondemand.platform) == (
        "OnDemand", "Prov", "Web"
    )
    assert (ondemand.pct25_viewed, ondemand.pct50_viewed) == (1, 0)


def test_exclusion_list(spark, dims):
    events = [_event(i, device_id=f"d{i}") for i in range(1, 6)]
    events.append(_event(6, device_id=None))
    kept = {r.event_id for r in _merged(spark, dims, events).collect()}
    assert kept == {1, 3, 4, 5, 6}
    # The list is about live viewing only.
    on_demand = _event(7, device_id="d2", entity_type="On-Demand", media_guid="m1")
    assert _merged(spark, dims, [on_demand]).count() == 1


def test_unknown_and_invalid_assets_are_dropped(spark, dims):
    events = [_event(1, program_id="p3"), _event(2, program_id="p4"),
              _event(3, program_id="none"), _event(4, program_id=None)]
    assert _merged(spark, dims, events).count() == 0


def test_copies_collapse(spark, dims):
    events = [_event(1)] * 3 + [_event(2, entity_type="On-Demand", media_guid="m1")] * 2
    assert _merged(spark, dims, events).count() == 2


def test_window_bounds_are_local_days(spark, dims):
    # Local days 2024-01-08 to 2024-01-15; local midnight is 05:00 UTC.
    events = [
        _event(1, event_timestamp=_ms("2024-01-08 04:59:59") + 999),
        _event(2, event_timestamp=_ms("2024-01-08 05:00:00")),
        _event(3, event_timestamp=_ms("2024-01-16 04:59:59") + 999),
        _event(4, event_timestamp=_ms("2024-01-16 05:00:00")),
    ]
    merged = _merged(spark, dims, events)
    days = {r.event_id: r.eventdate for r in merged.collect()}
    assert days == {2: dt.date(2024, 1, 8), 3: dt.date(2024, 1, 15)}


def test_arrival_key_bounds(spark, dims):
    keys = [20231231, 20240101, 20240116, 20240117]
    events = [_event(i, event_datekey=k) for i, k in enumerate(keys)]
    assert {r.event_id for r in _merged(spark, dims, events).collect()} == {1, 2}


def test_filters_reach_the_scan(spark, dims, tmp_path):
    events = [_event(i, event_datekey=20240101 + i) for i in range(20)]
    raw = spark.createDataFrame(
        [[e[f.name] for f in schema("raw_events")] for e in events], schema("raw_events")
    )
    tables.write_table(raw, str(tmp_path / "raw_events"), "event_datekey")
    stored = tables.read_table(spark, str(tmp_path), "raw_events")
    live = conform.conform(stored, {conform.LIVE: dims[0]}, AS_OF)
    plan = plan_of(live)
    scan = next(block for block in plan.split("\n\n") if "raw_events" in block)
    assert "event_datekey" in scan.split("PartitionFilters")[1].split("\n")[0]
    pushed = scan.split("PushedFilters")[1].split("\n")[0]
    low, high = _ms("2024-01-08 05:00:00"), _ms("2024-01-16 05:00:00")
    assert f"GreaterThanOrEqual(event_timestamp,{low})" in pushed
    assert f"LessThan(event_timestamp,{high})" in pushed
    assert "media_guid" not in scan.split("ReadSchema")[1]
    assert live.count() == 16


def test_view_is_readable_from_sql(spark, dims):
    tables.create_view(_merged(spark, dims, [_event(1)]), "merged_events_view")
    live = spark.sql("SELECT * FROM merged_events_view WHERE content_type = 'Live'")
    assert live.count() == 1
    # A filter on the content type is one on the entity type, next to the scan.
    assert "Live)" in plan_of(live) and "On-Demand" not in plan_of(live)
    assert live.agg(F.sum("pct25_viewed")).first()[0] == 1


def test_only_live_rows_with_an_asset_are_shuffled_for_the_exclusion(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    names = ["raw_events", "live_assets", "ondemand_assets", "live_filtered_devices"]
    for name in names:
        getattr(star_schema, name)(spark, folder).write.parquet(f"{tmp_path}/{name}")
    raw, live, ondemand, devices = (tables.read_table(spark, str(tmp_path), name) for name in names)
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # The size of events from which Spark filters them at the scan.
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1B",
    }
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        merged = conform.merge_events(raw, live, ondemand, devices, star_schema.AS_OF)
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        rows = merged.count()
    finally:
        for name in changed:
            spark.conf.unset(name)
    assert rows == conform.merge_events(raw, live, ondemand, devices, star_schema.AS_OF).count() > 0
    live, ondemand = plan.split("Project [OnDemand AS content_type")
    # One exclusion, of live rows; the keys of both branches are tested right above their scans.
    assert live.count("LeftAnti") == 1 and "LeftAnti" not in ondemand
    for branch in (live, ondemand):
        [test] = [line for line in branch.split("\n") if "might_contain" in line]
        assert "Filter" in test and "event_timestamp" in test
        assert branch.count("bloom_filter_agg") == 1
