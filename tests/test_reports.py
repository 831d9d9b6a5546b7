import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally.operators import paging
from playtally.params import ReportParams
from playtally.plans import reports
from playtally.sources import csv_sink, tables
from playtally.sources.schemas import schema
from tests.conftest import plan_of

DAY = dt.date(2023, 5, 26)
PARAMS = ReportParams(DAY, DAY)


def _fact(**changes):
    row = {
        "event_date": DAY, "asset_id": 1, "platform": "Web", "brand": "E", "content_type":
        "OnDemand", "x1_user_type": None, "gracenote_id": None, "total_duration": 100,
        "air_date": "2020", "content_starts": 1, "pct25_viewed": 1, "pct50_viewed": 1,
        "pct75_viewed": 0, "pct95_viewed": 0, "pct100_viewed": 0,
        "total_seconds_viewed": 10, "unique_devices": 1,
    }
    return {**row, **changes}


def _summary(spark, *facts):
    fields = schema("summary_daily")
    return spark.createDataFrame([[f[c.name] for c in fields] for f in facts], fields)


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame(
        [(1, "A", "Series", "Pilot", "1", "1", "Series", None, "x", "y"),
         (2, "B", "Other", "50%_off", "1", "1", "Movie", "TV-G", "x", "y")],
        schema("assets"),
    )


def test_rows_with_different_starts_stay_apart_unless_asked(spark, assets):
    summary = _summary(spark, _fact(), _fact(content_starts=2, gracenote_id=None))
    table = reports.performance(summary, assets, PARAMS)
    assert sorted(r.content_starts for r in table.collect()) == [1, 2]
    merged = reports.performance(summary, assets, PARAMS, group_by_starts=False)
    assert [r.content_starts for r in merged.collect()] == [3]


def test_performance_filters_and_brand_of_the_asset(spark, assets):
    summary = _summary(
        spark, _fact(), _fact(gracenote_id="EP1"), _fact(platform="Connected"),
        _fact(content_type="Live"), _fact(event_date=dt.date(2023, 5, 27)), _fact(asset_id=9),
    )
    rows = reports.performance(summary, assets, PARAMS).collect()
    assert [(r.product, r.brand, r.asset_id) for r in rows] == [("TVE", "A", 1)]


def test_product_filter_and_labels(spark, assets):
    summary = _summary(
        spark, _fact(x1_user_type="IntroTV"), _fact(x1_user_type=""),
        _fact(x1_user_type="introtv", gracenote_id="EP1"),
    )
    second = ReportParams(DAY, DAY, product="nowtv")
    screen = reports.performance(summary, assets, second).collect()
    assert [r["product"] for r in screen] == ["NOWTV"]
    export = reports.export(reports.VOD_PERFORMANCE, summary, assets, second).collect()
    assert [r["product"] for r in export] == ["NOW TV"]
    default = ReportParams(DAY, DAY, product="tve")
    assert [r["product"] for r in reports.performance(summary, assets, default).collect()] == [
        "TVE"
    ]


def test_brand_list(spark, assets):
    summary = _summary(spark, _fact(), _fact(asset_id=2))

    def brands(**params):
        table = reports.performance(summary, assets, ReportParams(DAY, DAY, **params))
        return sorted(r.brand for r in table.collect())

    assert brands() == ["A", "B"]
    assert brands(brands=["B"]) == ["B"]
    assert brands(brands=[]) == []
    assert brands(series_title="OTHER") == ["B"]
    assert brands(video_title="50%_") == ["B"]
    assert brands(video_title="nothing") == []


def test_entitled_brands_filter(spark, assets):
    summary = _summary(spark, _fact(), _fact(asset_id=2))
    entitled = spark.createDataFrame([("B",), ("B",), ("C",)], "name string")
    rows = reports.performance(summary, assets, PARAMS, entitled=entitled).collect()
    assert [r.brand for r in rows] == ["B"]


def test_export_keeps_rows_that_differ_in_hidden_keys(spark, assets):
    """Two user types of the default product look alike but stay two rows."""
    summary = _summary(
        spark, _fact(gracenote_id="EP1"), _fact(gracenote_id="EP1", x1_user_type=""),
        _fact(gracenote_id="EP1", x1_user_type=""),
    )
    by_type = reports.export(reports.VOD_PERFORMANCE_BY_USER_TYPE, summary, assets, PARAMS)
    assert by_type.count() == 2
    plain = reports.export(reports.VOD_PERFORMANCE, summary, assets, PARAMS)
    assert plain.count() == 1
    assert plain.first().brand == "E"


def test_on_demand_unique_reports_show_starts_or_devices(spark, assets):
    facts = [_fact(gracenote_id="EP1", content_starts=7, unique_devices=3),
             _fact(gracenote_id=None, content_starts=7, unique_devices=4)]
    summary = _summary(spark, *facts)
    daily = reports.export(reports.VOD_UNIQUE_DAILY, summary, assets, PARAMS)
    assert [r.content_starts for r in daily.collect()] == [7]
    devices = reports.export(
        reports.count_devices(reports.VOD_UNIQUE_DAILY), summary, assets, PARAMS
    )
    assert [r.unique_devices for r in devices.collect()] == [3]
    # Weekly and monthly reports do not look at the episode id.
    weekly = reports.export(reports.VOD_UNIQUE_WEEKLY, summary, assets, PARAMS)
    assert weekly.count() == 2
    monthly = reports.export(reports.VOD_UNIQUE_MONTHLY, summary, assets, PARAMS)
    assert sorted(r.unique_devices for r in monthly.collect()) == [3, 4]


@pytest.mark.parametrize("spec", reports.EXPORTS.values(), ids=reports.EXPORTS)
def test_headings_fit_the_columns(spec):
    assert len(spec.headings) == len(spec.columns) + len(spec.notes)
    assert len(set(spec.headings)) == len(spec.headings)


def test_column_counts():
    sizes = {name: len(spec.columns) for name, spec in reports.EXPORTS.items()}
    assert sizes == {
        "vod_performance": 22, "vod_performance_by_user_type": 22, "vod_unique_daily": 16,
        "vod_unique_weekly": 16, "vod_unique_monthly": 16, "live_unique_daily": 18,
        "live_unique_weekly": 18, "live_unique_monthly": 18,
    }


def test_chart(spark, assets):
    next_day = dt.date(2023, 5, 27)
    summary = _summary(
        spark, _fact(), _fact(asset_id=2), _fact(event_date=next_day, x1_user_type="introtv")
    )
    rows = reports.performance_chart(summary, assets, ReportParams(DAY, next_day)).collect()
    assert [tuple(r) for r in rows] == [("TVE", 20230526, 2), ("NOWTV", 20230527, 1)]


def test_pages_partition_the_table(spark):
    rows = [(i % 3 if i % 7 else None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b int")
    for direction in ("asc", "desc"):
        keys = [("a", direction)]
        whole = [tuple(r) for r in paging.ordered(df, keys).collect()]
        nulls_last = direction == "asc"
        assert (whole[-1][0] is None) == nulls_last
        offset = [
            tuple(r) for n in range(1, 7) for r in paging.page(df, keys, n, 10).collect()
        ]
        assert offset == whole
        walked, last = [], None
        while batch := paging.page_after(df, keys, last, 10).collect():
            walked += [tuple(r) for r in batch]
            last = batch[-1].asDict()
        assert walked == whole
    with pytest.raises(ValueError):
        paging.page(df, [("a", "asc")], 0)
    with pytest.raises(ValueError):
        paging.ordered(df, [("a", "up")])


def test_page_is_top_k(spark, assets):
    page = reports.performance_page(_summary(spark, _fact()), assets, PARAMS)
    assert "TakeOrderedAndProject" in plan_of(page)


def test_filters_prune_the_stored_summary(spark, assets, tmp_path):
    facts = [_fact(event_date=dt.date(2023, 5, d)) for d in range(1, 29)]
    tables.write_table(_summary(spark, *facts), str(tmp_path / "summary_daily"), "event_date")
    stored = tables.read_table(spark, str(tmp_path), "summary_daily")
    second = ReportParams(DAY, DAY, product="tve")
    table = reports.performance(stored, assets, second)
    plan = plan_of(table)
    scan = next(b for b in plan.split("\n\n") if "summary_daily" in b)
    assert "event_date" in scan.split("PartitionFilters")[1].split("\n")[0]
    pushed = scan.split("PushedFilters")[1].split("\n")[0]
    for text in ("EqualTo(content_type,OnDemand)", "IsNull(gracenote_id)", "In(platform"):
        assert text in pushed
    assert "unique_devices" not in scan.split("ReadSchema")[1]
    # A filter on the product is one on the user type, below the aggregation.
    blocks = plan.split("\n\n")
    product = next(i for i, b in enumerate(blocks) if ") Filter" in b and "introtv" in b)
    join = next(i for i, b in enumerate(blocks) if "Join" in b and "Left keys" in b)
    assert product < join
    assert table.count() == 1


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a"b', None), (2, 'c\\"d', ""), (3, "e,f", "g")], "n int, t string, u string"
    ).orderBy("n")
    path = str(tmp_path / "out")
    csv_sink.write_csv(df.coalesce(1), path, ["No.", "Text", "More", "A note. Read it"])
    [part] = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert part.read_text().splitlines() == [
        "No.,Text,More,A note. Read it", '1,"a""b",,', '2,"c""d",,', '3,"e,f",g,'
    ]
    with pytest.raises(ValueError):
        csv_sink.with_headings(df, ["too", "few"])


def test_export_files_are_in_order(spark, assets, tmp_path):
    facts = [
        _fact(gracenote_id=f"EP{i}", brand=f"B{i % 5}", platform="Web" if i % 2 else "Mobile")
        for i in range(200)
    ]
    report = reports.export(reports.VOD_PERFORMANCE, _summary(spark, *facts), assets, PARAMS)
    csv_sink.write_csv(report, str(tmp_path / "x"), reports.VOD_PERFORMANCE.headings)
    lines = []
    for part in sorted((tmp_path / "x").glob("part-*.csv")):
        lines += part.read_text().splitlines()[1:]
    keys = [(line.split(",")[2], line.split(",")[1]) for line in lines]
    assert len(keys) == 200
    assert keys == sorted(keys)


def test_export_name():
    name = csv_sink.export_name(dt.date(2022, 11, 1), dt.date(2022, 11, 10))
    assert name == "metrics_20221101-20221110"


def test_duplicate_assets_multiply_like_a_join(spark, assets):
    twice = assets.unionByName(assets.where(F.col("asset_id") == 1))
    [row] = reports.performance(_summary(spark, _fact()), twice, PARAMS).collect()
    assert row.content_starts == 2
