"""Performance and unique-visitor reports over the summary tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions import contains, date_key, in_list, matches, product_label
from playtally.functions.labels import (
    SECOND_PRODUCT_IN_EXPORTS,
    SECOND_PRODUCT_ON_SCREEN,
)
from playtally.operators.paging import ordered, page
from playtally.operators.rollup import ADDITIVE_METRICS
from playtally.params import (
    EXPORT_PLATFORMS,
    SCREEN_PLATFORMS,
    ReportParams,
    export_product,
)

# Fixed value: rows of a page on screen.
PAGE_SIZE = 100

# The columns every export starts with, and their headings.
_COMMON = {
    "product": "Product",
    "platform": "Platform",
    "brand": "Brand",
    "event_date": "Date",
    "series_name": "Series Title",
    "episode_name": "Video Title",
    "episode_number": "Episode #",
    "season_number": "Season #",
    "program_type": "XTV Video Category",
    "rating": "Rating",
    "total_duration": "Length",
    "available_date": "Available Date",
    "air_date": "Air Date",
    "expiration_date": "Expiration Date",
    "gracenote_id": "Provider External ID",
}

# The metrics of each kind of export, and their headings.
_PERFORMANCE = {
    "content_starts": "Video Starts",
    "pct25_viewed": "25% Complete",
    "pct50_viewed": "50% Complete",
    "pct75_viewed": "75% Complete",
    "pct95_viewed": "95% Complete",
    "pct100_viewed": "Completes",
    "total_seconds_viewed": "Viewing Time",
}
_LIVE_UNIQUE = {
    "unique_devices": "Unique Visitors",
    "content_starts": "Live Video Starts",
    "total_seconds_viewed": "Viewing Time",
}
_VOD_UNIQUE_BY_STARTS = {"content_starts": "Unique Visitors"}
_VOD_UNIQUE_BY_DEVICES = {"unique_devices": "Unique Visitors"}

# Fixed value: the note in the header of the daily live export.
_NOT_ADDITIVE = (
    "Please note that the daily unique visitor metrics are not additive towards"
    " either a weekly or monthly unique visitor metric. For weekly or monthly"
    " unique visitor data, please run a weekly or monthly report, which will"
    " include de-duplicated weekly and monthly unique metrics."
)

# The order of every export.
EXPORT_ORDER = [
    ("brand", "asc"),
    ("content_type", "asc"),
    ("platform", "asc"),
    ("event_date", "asc"),
]

_ASSET_COLUMNS = {
    "series_name",
    "episode_name",
    "episode_number",
    "season_number",
    "program_type",
    "rating",
    "available_date",
    "expiration_date",
}


@dataclass(frozen=True)
class ReportSpec:
    """An export: which summary it reads and which rows stay apart.

    ``gracenote`` is 'null', 'not_null' or 'any'. ``hidden_keys`` are compared
    when rows are de-duplicated, but not shown.
    """

    name: str
    grain: str
    content_type: str
    metrics: dict[str, str]
    gracenote: str = "not_null"
    hidden_keys: tuple[str, ...] = ("x1_user_type", "content_type")
    notes: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*_COMMON, *self.metrics]

    @property
    def headings(self) -> list[str]:
        return [*_COMMON.values(), *self.metrics.values(), *self.notes]


# The exports. On-demand unique visitors of a day and a week are the starts;
# see `count_devices` for the devices the heading promises.
VOD_PERFORMANCE = ReportSpec(
    "vod_performance", "daily", "OnDemand", _PERFORMANCE, hidden_keys=("content_type",)
)
VOD_PERFORMANCE_BY_USER_TYPE = ReportSpec(
    "vod_performance_by_user_type", "daily", "OnDemand", _PERFORMANCE
)
VOD_UNIQUE_DAILY = ReportSpec(
    "vod_unique_daily", "daily", "OnDemand", _VOD_UNIQUE_BY_STARTS
)
VOD_UNIQUE_WEEKLY = ReportSpec(
    "vod_unique_weekly",
    "weekly",
    "OnDemand",
    _VOD_UNIQUE_BY_STARTS,
    gracenote="any",
    hidden_keys=("x1_user_type", "content_type", "unique_devices"),
)
VOD_UNIQUE_MONTHLY = ReportSpec(
    "vod_unique_monthly",
    "monthly",
    "OnDemand",
    _VOD_UNIQUE_BY_DEVICES,
    gracenote="any",
    hidden_keys=("x1_user_type", "content_type", "content_starts"),
)
LIVE_UNIQUE_DAILY = ReportSpec(
    "live_unique_daily", "daily", "Live", _LIVE_UNIQUE, notes=(_NOT_ADDITIVE,)
)
LIVE_UNIQUE_WEEKLY = ReportSpec("live_unique_weekly", "weekly", "Live", _LIVE_UNIQUE)
LIVE_UNIQUE_MONTHLY = ReportSpec("live_unique_monthly", "monthly", "Live", _LIVE_UNIQUE)

EXPORTS = {
    spec.name: spec
    for spec in (
        VOD_PERFORMANCE,
        VOD_PERFORMANCE_BY_USER_TYPE,
        VOD_UNIQUE_DAILY,
        VOD_UNIQUE_WEEKLY,
        VOD_UNIQUE_MONTHLY,
        LIVE_UNIQUE_DAILY,
        LIVE_UNIQUE_WEEKLY,
        LIVE_UNIQUE_MONTHLY,
    )
}


def count_devices(spec: ReportSpec) -> ReportSpec:
    """The on-demand unique report with devices where it shows starts."""
    hidden = tuple(k for k in spec.hidden_keys if k != "unique_devices")
    return replace(
        spec, metrics=_VOD_UNIQUE_BY_DEVICES, hidden_keys=(*hidden, "content_starts")
    )


def export(
    spec: ReportSpec,
    summary: DataFrame,
    assets: DataFrame,
    params: ReportParams,
    entitled: DataFrame | None = None,
    sort: bool = True,
) -> DataFrame:
    """Wide export: one row per distinct combination of the keys."""
    rows = _selected(
        summary, assets, params, spec.content_type, spec.gracenote,
        EXPORT_PLATFORMS, entitled,
    ).withColumn("product", product_label(F.col("x1_user_type"), SECOND_PRODUCT_IN_EXPORTS))
    product = export_product(params.product)
    if product is not None:
        rows = rows.where(matches(F.col("product"), product))
    keys = [*spec.columns, *[k for k in spec.hidden_keys if k not in spec.columns]]
    distinct = rows.select(*keys).distinct()
    if not sort:
        return distinct.select(*spec.columns)
    # Content type is one of the hidden keys of every export.
    return ordered(distinct, EXPORT_ORDER).select(*spec.columns)


def performance(
    summary: DataFrame,
    assets: DataFrame,
    params: ReportParams,
    group_by_starts: bool = True,
    entitled: DataFrame | None = None,
) -> DataFrame:
    """On-demand performance table, all rows.

    ``group_by_starts`` keeps summary rows with different starts apart, as the
    screen does; without it every asset has one row per day and platform.
    """
    rows = _selected(
        summary, assets, params, "OnDemand", "null", SCREEN_PLATFORMS, entitled
    ).withColumn("product", product_label(F.col("x1_user_type"), SECOND_PRODUCT_ON_SCREEN))
    if params.product is not None:
        rows = rows.where(matches(F.col("product"), params.product))
    keys = [
        "product", "platform", "asset_brand", "event_date", "series_name",
        "episode_name", "asset_id", "x1_user_type",
    ]
    starts = [F.col("content_starts").alias("starts_key")] if group_by_starts else []
    totals = [F.sum(name).alias(name) for name in ADDITIVE_METRICS]
    return (
        rows.groupBy(*keys, *starts)
        .agg(*totals)
        .select(
            "product", "platform", F.col("asset_brand").alias("brand"), "event_date",
            "series_name", "episode_name", "asset_id", *ADDITIVE_METRICS,
            "x1_user_type",
        )
    )


def performance_page(
    summary: DataFrame,
    assets: DataFrame,
    params: ReportParams,
    number: int = 1,
    size: int = PAGE_SIZE,
    group_by_starts: bool = True,
    entitled: DataFrame | None = None,
) -> DataFrame:
    """One page of the performance table in the order asked for."""
    table = performance(summary, assets, params, group_by_starts, entitled)
    return page(table, [params.order_by or ("content_starts", "desc")], number, size)


def performance_chart(
    summary: DataFrame,
    assets: DataFrame,
    params: ReportParams,
    entitled: DataFrame | None = None,
) -> DataFrame:
    """Starts per day and product, by day."""
    rows = _selected(
        summary, assets, params, "OnDemand", "null", SCREEN_PLATFORMS, entitled
    ).withColumn("product", product_label(F.col("x1_user_type"), SECOND_PRODUCT_ON_SCREEN))
    if params.product is not None:
        rows = rows.where(matches(F.col("product"), params.product))
    series = rows.groupBy("event_date", "product").agg(
        F.sum("content_starts").alias("totalStarts")
    )
    return ordered(
        series.select("product", date_key(F.col("event_date")).alias("date_key"), "totalStarts"),
        [("date_key", "asc"), ("product", "asc")],
    )


def _selected(
    summary: DataFrame,
    assets: DataFrame,
    params: ReportParams,
    content_type: str,
    gracenote: str,
    default_platforms: tuple[str, ...],
    entitled: DataFrame | None,
) -> DataFrame:
    """Summary rows a report is about, with the attributes of their assets.

    Brands are those of the asset; ``asset_brand`` carries them on. All
    filters sit below the join, next to the scans.
    """
    facts = summary.where(
        (F.col("content_type") == content_type)
        & in_list(F.col("platform"), params.platforms or default_platforms)
        & F.col("event_date").between(params.first_day, params.last_day)
        & _gracenote_filter(gracenote)
    )
    wanted = assets.select(
        "asset_id", F.col("brand").alias("asset_brand"), *sorted(_ASSET_COLUMNS)
    )
    if params.brands is not None:
        wanted = wanted.where(in_list(F.col("asset_brand"), params.brands))
    if entitled is not None:
        names = entitled.select(F.col("name").alias("asset_brand"))
        wanted = wanted.join(names, "asset_brand", "left_semi")
    if params.video_title:
        wanted = wanted.where(contains(F.col("episode_name"), params.video_title))
    if params.series_title:
        wanted = wanted.where(contains(F.col("series_name"), params.series_title))
    return facts.join(wanted, "asset_id")


def _gracenote_filter(state: str) -> Column:
    column = F.col("gracenote_id")
    tests = {"null": column.isNull(), "not_null": column.isNotNull(), "any": F.lit(True)}
    return tests[state]
