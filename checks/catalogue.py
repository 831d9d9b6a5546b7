"""Registered queries: name -> function of (session, folder of test tables)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally import functions as fn
from playtally.operators import (
    conform,
    corrections,
    membership,
    nest,
    numbering,
    paging,
    rollup,
    stacking,
    text_index,
    upserts,
)
from playtally.params import ReportParams, sort_key
from playtally.plans import documents, entitlements, reports
from playtally.session import configure
from playtally.sources import csv_sink, cuts, star_schema

YEAR_1998 = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))
SINCE = dt.date(1999, 1, 1)
EMAIL_PATTERNS = ["%building%", "%auto%"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    """The engine's tables, derived on demand from the test tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(star_schema, name)(self._spark, self._folder)

    def base(self, name: str) -> DataFrame:
        return star_schema.table(self._spark, self._folder, name)

    @property
    def plays(self) -> DataFrame:
        return rollup.plays_from_viewing(self.viewing)

    def summary(self, grain: str) -> DataFrame:
        return rollup.roll_up(self.plays, grain)

    @property
    def excluded(self) -> DataFrame:
        return conform.excluded_devices(self.live_filtered_devices)

    @property
    def merged_events(self) -> DataFrame:
        return conform.merge_events(
            self.raw_events, self.live_assets, self.ondemand_assets,
            self.live_filtered_devices, star_schema.AS_OF,
        )


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
    return function


# --- reports ---------------------------------------------------------------


@query
def vod_performance_table(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, product="nowtv")
    return reports.performance(t.summary("daily"), t.assets, params)


@query
def vod_performance_totals(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, series_title="promo", video_title="r")
    return reports.performance(t.summary("daily"), t.assets, params, group_by_starts=False)


@query
def vod_performance_page(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, order_by=("total_seconds_viewed", "desc"))
    return reports.performance_page(t.summary("daily"), t.assets, params, number=2)


@query
def vod_performance_page_after(t: Tables) -> DataFrame:
    """The same second page, by position instead of offset."""
    params = ReportParams(*YEAR_1998)
    table = reports.performance(t.summary("daily"), t.assets, params)
    after = {
        "product": "TVE", "platform": "Web", "brand": "Brand#13",
        "event_date": dt.date(1998, 6, 30), "series_name": "M", "episode_name": "m",
        "asset_id": 0, "content_starts": 0, "pct25_viewed": 0, "pct50_viewed": 0,
        "pct75_viewed": 0, "pct95_viewed": 0, "pct100_viewed": 0,
        "total_seconds_viewed": 0, "x1_user_type": None,
    }
    return paging.page_after(table, [("brand", "asc"), ("event_date", "desc")], after, 100)


@query
def vod_performance_count(t: Tables) -> DataFrame:
    table = reports.performance(t.summary("daily"), t.assets, ReportParams(*YEAR_1998))
    return paging.row_count(table)


@query
def vod_performance_of_brand_ids(t: Tables) -> DataFrame:
    """Export of brands given by id, as a request names them."""
    viewed = t.brands.withColumn("name", F.replace(F.col("name"), F.lit(" "), F.lit("#")))
    return reports.export(
        reports.VOD_PERFORMANCE, t.summary("daily"), t.assets, ReportParams(*YEAR_1998),
        entitled=entitlements.brand_names(viewed, [3, 8, 48, 60]),
    )


@query
def vod_performance_chart(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, brands=["Brand#1", "Brand#7", "Brand#20"])
    return reports.performance_chart(t.summary("daily"), t.assets, params)


@query
def vod_performance_export(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, product="tve", series_title="o")
    return reports.export(reports.VOD_PERFORMANCE, t.summary("daily"), t.assets, params)


@query
def vod_performance_export_by_user_type(t: Tables) -> DataFrame:
    params = ReportParams(*YEAR_1998, platforms=["Web"])
    return reports.export(
        reports.VOD_PERFORMANCE_BY_USER_TYPE, t.summary("daily"), t.assets, params
    )


def _export(spec: reports.ReportSpec, t: Tables, **params: object) -> DataFrame:
    return reports.export(
        spec, t.summary(spec.grain), t.assets, ReportParams(*YEAR_1998, **params)
    )


@query
def vod_unique_daily(t: Tables) -> DataFrame:
    return _export(reports.VOD_UNIQUE_DAILY, t, product="NOWTV")


@query
def vod_unique_daily_devices(t: Tables) -> DataFrame:
    return _export(reports.count_devices(reports.VOD_UNIQUE_DAILY), t, product="NOWTV")


@query
def vod_unique_weekly(t: Tables) -> DataFrame:
    return _export(reports.VOD_UNIQUE_WEEKLY, t)


@query
def vod_unique_monthly(t: Tables) -> DataFrame:
    return _export(reports.VOD_UNIQUE_MONTHLY, t)


@query
def live_unique_daily(t: Tables) -> DataFrame:
    return _export(reports.LIVE_UNIQUE_DAILY, t, platforms=["Web", "Connected"])


@query
def live_unique_weekly(t: Tables) -> DataFrame:
    return _export(reports.LIVE_UNIQUE_WEEKLY, t)


@query
def live_unique_monthly(t: Tables) -> DataFrame:
    return _export(reports.LIVE_UNIQUE_MONTHLY, t)


@query
def live_unique_monthly_entitled(t: Tables) -> DataFrame:
    """Monthly export of the brands whose asset number a supplier shares."""
    names = t.base("supplier").where(F.col("s_acctbal") > 5000).select(
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("name")
    )
    return reports.export(
        reports.LIVE_UNIQUE_MONTHLY, t.summary("monthly"), t.assets,
        ReportParams(*YEAR_1998), entitled=names,
    )


@query
def vod_performance_sorted_page(t: Tables) -> DataFrame:
    """First page in the order of a request field."""
    params = ReportParams(*YEAR_1998, order_by=sort_key("title desc"))
    return reports.performance_page(t.summary("daily"), t.assets, params)


@query
def csv_export_read_back(t: Tables) -> DataFrame:
    """The daily live export as its file has it: headings, a note, and texts."""
    spec, params = reports.LIVE_UNIQUE_DAILY, ReportParams(*YEAR_1998, platforms=["Web", "Connected"])
    report = reports.export(spec, t.summary("daily"), t.assets, params)
    path = f"{cuts.shared_folder(report.sparkSession)}/{uuid.uuid4().hex}/{csv_sink.export_name(*YEAR_1998)}"
    csv_sink.write_csv(report, path, spec.headings)
    found = report.sparkSession.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    return found.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -2))


@query
def request_days(t: Tables) -> DataFrame:
    """First and last day of requests in several forms, and days of epoch milliseconds."""
    number = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("string")
    forms = ["T00:00:00+09:00", "T02:30:00+03:00", "T22:15:00-05:00", "", "T23:59:59Z", "T23:59:59+0200"]
    form = F.get(F.array(*map(F.lit, forms)), (number % len(forms)).cast("int"))
    text = F.concat(day, form)
    epoch = F.when(number % 11 == 0, "soon").otherwise(((number * 7919000777) % 4000000000000 - 1000000000000).cast("string"))
    return t.base("orders").select(
        "o_orderkey",
        fn.first_request_day(text).alias("first_day"),
        fn.last_request_day(text).alias("last_day"),
        fn.day_of_epoch_ms(epoch).alias("epoch_day"),
    )


# --- conformance -----------------------------------------------------------


@query
def merged_events_live(t: Tables) -> DataFrame:
    return conform.conform(
        t.raw_events, {conform.LIVE: t.live_assets}, star_schema.AS_OF, t.excluded
    )


@query
def merged_events_ondemand(t: Tables) -> DataFrame:
    return conform.conform(
        t.raw_events, {conform.ONDEMAND: t.ondemand_assets}, star_schema.AS_OF
    )


@query
def merged_events_all(t: Tables) -> DataFrame:
    return t.merged_events


@query
def device_exclusion_antijoin(t: Tables) -> DataFrame:
    return (
        t.raw_events.where(F.col("entity_type") == "Live")
        .join(t.excluded, ["device_id", "program_id"], "left_anti")
        .select("event_id", "device_id", "program_id")
    )


@query
def completion_flags(t: Tables) -> DataFrame:
    flags = fn.completion_flags(F.col("duration_secs"), F.col("viewed_secs"))
    return t.raw_events.select(
        "event_id", *[flag.alias(name) for name, flag in flags.items()]
    )


@query
def platform_bucket(t: Tables) -> DataFrame:
    return t.raw_events.select(
        "event_id",
        fn.platform_bucket(F.col("platform")).alias("platform"),
        fn.blank_to_na(F.col("company")).alias("brand"),
        fn.zero_if_blank(F.col("duration_secs")).alias("duration_secs"),
        fn.product_label(F.col("x1_user_type")).alias("product"),
    )


@query
def event_day_est(t: Tables) -> DataFrame:
    day = fn.event_day(F.col("event_timestamp"))
    return t.raw_events.select(
        "event_id",
        day.alias("event_day"),
        fn.date_key(day).alias("date_key"),
        fn.key_of_day_text(day.cast("string")).alias("date_key_of_text"),
        fn.period_start(day, "weekly").alias("week"),
        fn.period_start(day, "monthly").alias("month"),
    )


@query
def local_day_range(t: Tables) -> DataFrame:
    seconds = F.call_function("div", F.col("event_timestamp"), F.lit(1000))
    return t.raw_events.where(
        fn.on_local_day(seconds, dt.date(2024, 1, 9), dt.date(2024, 1, 11))
    ).select("event_id", "event_timestamp")


@query
def local_day_start(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    start = fn.local_day_start(day)
    return t.base("orders").select(
        "o_orderkey",
        start.alias("starts_at"),
        (fn.local_day_start(F.date_add(day, 1)) - start).alias("seconds"),
    )


# --- roll-ups --------------------------------------------------------------


@query
def rollup_daily(t: Tables) -> DataFrame:
    return t.summary("daily")


@query
def rollup_weekly(t: Tables) -> DataFrame:
    return rollup.roll_up_device_days(rollup.device_days(t.plays), "weekly")


@query
def rollup_monthly(t: Tables) -> DataFrame:
    return t.summary("monthly")


@query
def rollup_daily_from_device_days(t: Tables) -> DataFrame:
    return rollup.roll_up_device_days(rollup.device_days(t.plays), "daily")


@query
def rollup_conformed_events(t: Tables) -> DataFrame:
    return rollup.roll_up(rollup.plays_from_events(t.merged_events), "daily")


@query
def event_report_daily(t: Tables) -> DataFrame:
    """Raw events to the daily live export: conformed, summarised, joined to their assets."""
    summary = rollup.roll_up(rollup.plays_from_events(t.merged_events), "daily")
    return reports.export(
        reports.LIVE_UNIQUE_DAILY, summary, rollup.assets_from_events(t.merged_events),
        ReportParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
    )


@query
def event_report_performance(t: Tables) -> DataFrame:
    """Raw events to the on-demand performance table."""
    summary = rollup.roll_up(rollup.plays_from_events(t.merged_events), "daily")
    return reports.performance(
        summary, rollup.assets_from_events(t.merged_events),
        ReportParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31)), group_by_starts=False,
    )


@query
def merged_events_incremental(t: Tables) -> DataFrame:
    """Two overlapping run days, the first of which finds half of what arrives on its day."""
    first_day, last_day = star_schema.AS_OF - dt.timedelta(days=3), star_schema.AS_OF
    key = int(f"{first_day:%Y%m%d}")
    arrived = (F.col("event_datekey") < key) | ((F.col("event_datekey") == key) & (F.col("event_id") % 4 < 2))
    branches = {conform.LIVE: t.live_assets, conform.ONDEMAND: t.ondemand_assets}
    first = conform.conform_increment(
        t.raw_events.where(arrived), None, branches, first_day, None, t.excluded
    )
    second = conform.conform_increment(
        t.raw_events, first, branches, last_day, first_day, t.excluded
    )
    return first.unionByName(second)


@query
def unique_devices_by_grain(t: Tables) -> DataFrame:
    return rollup.unique_devices(t.plays, ["brand", "content_type"])


@query
def unique_devices_by_sketch(t: Tables) -> DataFrame:
    """Whether the merged daily sketches come near the exact count of the month."""
    by = ["brand", "content_type"]
    exact = rollup.unique_devices(t.plays, by, ["monthly"])
    close = rollup.devices_from_sketches(
        rollup.device_sketches(t.plays, by), "monthly", by
    ).withColumnRenamed("unique_devices", "estimate")
    error = F.abs(F.col("estimate") - F.col("unique_devices"))
    return exact.join(close, ["event_date", *by]).select(
        "event_date", *by, "unique_devices",
        (error <= F.greatest(F.lit(1.0), F.col("unique_devices") * 0.05)).alias("is_close"),
    )


@query
def product_backfill(t: Tables) -> DataFrame:
    days = dt.date(1998, 5, 1), dt.date(1998, 7, 31)
    brands = ["Brand#1", "Brand#2", "Brand#3"]
    return corrections.correct(
        t.summary("daily"),
        [
            corrections.Correction("x1_user_type", "", *days, brands[:1], F.col("pct100_viewed") == 0),
            corrections.Correction("x1_user_type", "introtv", *days, brands, F.col("pct100_viewed") == 0),
            corrections.Correction("x1_user_type", "", *days, brands, F.col("pct100_viewed") > 0),
        ],
    )


# --- entitlements ----------------------------------------------------------


@query
def brand_activity(t: Tables) -> DataFrame:
    return entitlements.brand_activity(t.summary("daily"), SINCE)


def _viewing_of_brands(t: Tables) -> DataFrame:
    """Viewing whose brands are named after brands of the entitlements."""
    return t.viewing.withColumn("brand", F.replace(F.col("brand"), F.lit("#"), F.lit(" ")))


def _summary_of_brands(t: Tables) -> DataFrame:
    """Daily summary whose brands are named after brands of the entitlements."""
    return t.summary("daily").withColumn("brand", F.replace(F.col("brand"), F.lit("#"), F.lit(" ")))


@query
def brands_by_group(t: Tables) -> DataFrame:
    summary = _summary_of_brands(t)
    return entitlements.brands_by_group(
        t.brands, t.groups, t.groups_brands, t.users_groups, t.users_brands, summary, SINCE
    )


@query
def providers_brands(t: Tables) -> DataFrame:
    return entitlements.providers_with_brands(t.providers, t.brands, t.providers_brands)


@query
def access_by_domain(t: Tables) -> DataFrame:
    return entitlements.access_by_email(
        t.users, t.users_groups, t.groups, t.groups_brands, t.brands, EMAIL_PATTERNS
    )


@query
def legacy_access_union(t: Tables) -> DataFrame:
    return entitlements.legacy_access(
        t.legacy_users, t.legacy_users_live_groups, t.legacy_live_groups,
        t.legacy_users_vod_groups, t.legacy_vod_groups, EMAIL_PATTERNS,
    )


@query
def system_comparison(t: Tables) -> DataFrame:
    return entitlements.system_comparison(
        t.users, t.users_roles, t.users_groups, t.users_brands,
        t.legacy_users, t.legacy_users_roles, t.legacy_users_vod_groups,
        t.legacy_users_brands,
    )


@query
def user_search(t: Tables) -> DataFrame:
    return entitlements.find_users(t.users, name="000012")


@query
def user_search_either(t: Tables) -> DataFrame:
    return entitlements.find_users(t.users, "99", "@MACHINERY", mode="either")


@query
def user_search_indexed(t: Tables) -> DataFrame:
    """Searches by a stored trigram index: by name, by both parts, by either, and by parts too short for it."""
    index = text_index.build_index(t.users, "user_id", ["name", "email"])
    path = f"{cuts.shared_folder(index.sparkSession)}/{uuid.uuid4().hex}"
    text_index.write_index(index, path)
    stored = text_index.read_index(index.sparkSession, path)
    searches = [
        ("name", "000012", ""), ("name", "R#00_0001", ""), ("name", "1", ""), ("both", "00001", "@bu%ing"),
        ("both", "7", "FURN"), ("either", "00099", "@MACHINERY"), ("either", "99", "@MACHINERY"),
    ]
    return stacking.stack(
        [
            entitlements.find_users_indexed(t.users, stored, name, email, mode).select(
                F.lit(f"{mode} {name} {email}").alias("search"), "*"
            )
            for mode, name, email in searches
        ]
    )


@query
def users_where(t: Tables) -> DataFrame:
    return entitlements.rows_where(
        t.users, [("email", "ilike", "%@b%"), ("is_active", "=", True), ("user_id", ">=", 100)]
    )


@query
def brands_by_name(t: Tables) -> DataFrame:
    return entitlements.rows_where(t.brands, [("name", "in", ["Brand 3", "Brand 30", "None"])])


@query
def legacy_user_by_email(t: Tables) -> DataFrame:
    by_email = [("email", "=", "u9@building.example")]
    by_name = [("name", "=", "Customer#000000010")]
    return entitlements.rows_where(t.legacy_users, by_email).unionByName(
        entitlements.rows_where(t.legacy_users, by_name)
    )


@query
def roles_in_order(t: Tables) -> DataFrame:
    return entitlements.roles_in_order(t.roles, by="label")


@query
def users_page(t: Tables) -> DataFrame:
    return entitlements.users_page(t.users, number=3)


@query
def user_by_email(t: Tables) -> DataFrame:
    """Look-ups in any case, one for each segment that a user may be in, so that some find the user."""
    segments = ["Automobile", "BUILDING", "furniture", "Household", "maCHINERY"]
    found = [
        entitlements.user_by_email(t.users, f"U{number}@{segment}.example", is_active=is_active)
        for segment in segments
        for number, is_active in ((7, True), (12, True), (12, False))
    ]
    return stacking.stack(found)


@query
def groups_of_user(t: Tables) -> DataFrame:
    return entitlements.groups_of_user(t.users_groups, t.groups, 30)


@query
def canonical_brands(t: Tables) -> DataFrame:
    return entitlements.canonical_brands(t.brands)


@query
def brand_names(t: Tables) -> DataFrame:
    return entitlements.brand_names(t.brands, range(5, 60, 5))


@query
def entitled_brands(t: Tables) -> DataFrame:
    return entitlements.entitled_brands(
        t.users_brands, t.users_groups, t.groups_brands, t.brands, ["OnDemand"]
    )


@query
def entitled_brands_of_user(t: Tables) -> DataFrame:
    return entitlements.entitled_brands(
        t.users_brands, t.users_groups, t.groups_brands, t.brands, user_id=30
    )


@query
def roles_by_name(t: Tables) -> DataFrame:
    requests = t.base("orders").groupBy("o_custkey").agg(
        F.min("o_orderpriority").alias("lowest")
    ).select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("lowest") == "1-URGENT", "BUILDING,MACHINERY,OTHER")
        .otherwise("FURNITURE").alias("roles"),
    )
    return entitlements.roles_by_name(requests, t.roles)


# --- documents -------------------------------------------------------------


@query
def user_documents(t: Tables) -> DataFrame:
    return nest.as_json(documents.user_documents(
        t.users, t.users_groups, t.groups, t.users_brands, t.brands, t.users_roles, t.roles
    ))


@query
def group_documents(t: Tables) -> DataFrame:
    return nest.as_json(documents.group_documents(
        t.groups, t.groups_brands, t.brands, t.users_groups, t.users
    ))


@query
def group_documents_live(t: Tables) -> DataFrame:
    return nest.as_json(documents.group_documents(
        t.groups, t.groups_brands, t.brands, t.users_groups, t.users, content_type="LIVE"
    ))


@query
def brand_documents(t: Tables) -> DataFrame:
    return nest.as_json(documents.brand_documents(
        t.brands, t.brands_brands, t.users_brands, t.users
    ))


@query
def user_records(t: Tables) -> DataFrame:
    return nest.as_json(_user_records(t))


@query
def short_user_records(t: Tables) -> DataFrame:
    return nest.as_json(documents.short_user_records(_user_records(t)))


def _user_records(t: Tables) -> DataFrame:
    second = documents.second_product_brands(_viewing_of_brands(t), t.brands)
    return documents.user_records(
        t.users, t.users_groups, t.groups, t.users_brands, t.brands, t.users_roles,
        t.roles, t.providers, t.providers_brands, second,
    )


@query
def option_list(t: Tables) -> DataFrame:
    def tagged(kind: str, options: DataFrame) -> DataFrame:
        return options.select(F.lit(kind).alias("kind"), "*")

    return (
        tagged("brand", documents.brand_options(t.brands, "ondemand"))
        .unionByName(tagged("group", documents.group_options(t.groups, "live")))
        .unionByName(tagged("user", documents.user_options(t.users)))
    )


@query
def document_children(t: Tables) -> DataFrame:
    return documents.user_children(t.users, t.users_groups, t.groups, t.users_brands, t.brands)


@query
def second_product_brands(t: Tables) -> DataFrame:
    return documents.second_product_brands(_viewing_of_brands(t), t.brands)


def _numbered_names(t: Tables) -> DataFrame:
    """Names of mixed case, with blanks, leading zeros and runs of up to 60 digits."""
    number = F.col("c_custkey")
    text = number.cast("string")
    tail = (number % 40).cast("string")
    return t.base("customer").select(
        number.alias("user_id"),
        F.when(number % 6 == 0, F.concat(F.lit("Brand "), tail))
        .when(number % 6 == 1, F.concat(F.lit(" bRAND\t00"), tail, F.lit("b"), (number % 7).cast("string")))
        .when(number % 6 == 2, F.concat(F.lit("x"), F.repeat(F.lit("9"), (number % 60 + 1).cast("int"))))
        .when(number % 6 == 3, F.concat(F.lit("X"), text, F.repeat(F.lit("0"), (number % 30).cast("int"))))
        .when(number % 6 == 4, F.concat(F.lit("Brand#"), tail))
        .otherwise(text)
        .alias("name"),
    )


@query
def natural_sort_rank(t: Tables) -> DataFrame:
    return numbering.ranked(_numbered_names(t), fn.natural_order(F.col("name")))


@query
def natural_sort_key(t: Tables) -> DataFrame:
    return t.users.select("name", fn.natural_key(F.col("name")).alias("sort_key")).unionByName(
        t.brands.select("name", fn.natural_key(F.col("name")).alias("sort_key"))
    )


@query
def id_list_parse(t: Tables) -> DataFrame:
    number = F.col("brand_id").cast("string")
    text = (
        F.when(F.col("brand_id") % 5 == 0, "")
        .when(F.col("brand_id") % 5 == 1, F.concat(number, F.lit("|"), number, F.lit(", 7|7,x")))
        .otherwise(F.concat(number, F.lit(",46,34")))
    )
    ids = fn.id_list(text)
    return t.brands.select(
        "brand_id",
        text.alias("list"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"),
    )


@query
def word_list_parse(t: Tables) -> DataFrame:
    number = F.col("p_partkey")
    text = (
        F.when(number % 5 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")))
        .when(number % 5 == 1, F.concat(F.lit(" ,"), F.col("p_name"), F.lit(",, ")))
        .when(number % 5 == 2, F.when(number % 2 == 0, " , ").when(number % 3 == 0, ""))
        .otherwise(F.col("p_name"))
    )
    words = fn.word_list(text, ["Web", "Mobile"])
    return t.base("part").select("p_partkey", F.array_join(words, "/").alias("words"))


# --- membership ------------------------------------------------------------


@query
def membership_diff(t: Tables) -> DataFrame:
    return membership.membership_diff(
        t.users_brands, t.desired_users_brands, "user_id", "brand_id"
    )


@query
def membership_diff_in_scope(t: Tables) -> DataFrame:
    scope = t.users.where(F.col("email").like("%@building%"))
    return membership.membership_diff(
        t.users_brands, t.desired_users_brands, "user_id", "brand_id", scope
    )


@query
def membership_delete_expansion(t: Tables) -> DataFrame:
    diff = membership.membership_diff(
        t.users_brands, t.desired_users_brands, "user_id", "brand_id"
    )
    return membership.expand_deletes(t.users_brands, diff, t.brands, "user_id", "brand_id")


def _brands_of_three_types(t: Tables) -> DataFrame:
    kind = F.when(F.col("brand_id") % 10 == 5, "Radio").otherwise(F.col("content_type"))
    return t.brands.withColumn("content_type", kind)


@query
def membership_sync(t: Tables) -> DataFrame:
    """Two content types are edited for all users; links of the third stay."""
    scope = t.users.select("user_id", F.explode(F.array(F.lit("Live"), F.lit("OnDemand"))).alias("content_type"))
    changes = membership.membership_changes(
        t.users_brands, t.desired_users_brands, "user_id", "brand_id", _brands_of_three_types(t), scope
    )
    return membership.apply_changes(t.users_brands, changes, "user_id", "brand_id")


@query
def membership_sync_from_lists(t: Tables) -> DataFrame:
    """Users send lists of ids: of some brands they have, of others, of nothing, or none at all."""
    number, brand = F.col("c_custkey"), F.col("brand_id")
    item = F.concat(brand.cast("string"), F.lit("|"), brand.cast("string"))
    kept = t.users_brands.where((F.col("user_id") + brand) % 5 != 0).groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_list(item)), ",").alias("own")
    )
    extra = F.concat((number % 90 + 1).cast("string"), F.lit("|7, "), (number % 17).cast("string"), F.lit(",x"))
    requests = (
        t.base("customer").where(number % 3 != 0)
        .join(kept, number == F.col("user_id"), "left")
        .select(
            number.alias("user_id"),
            F.when(number % 4 == 0, "").when(number % 4 != 1, F.concat_ws(",", extra, "own")).alias("vodBrandsConcat"),
            F.when(number % 5 != 0, F.coalesce("own", F.lit(""))).alias("liveStreamBrandsConcat"),
        )
    )
    lists = {"vodBrandsConcat": "OnDemand", "liveStreamBrandsConcat": "Live"}
    return membership.sync_from_lists(
        t.users_brands, requests, lists, "user_id", "brand_id", _brands_of_three_types(t)
    )


@query
def requested_id_list(t: Tables) -> DataFrame:
    """Two lists of a request as one array of ids."""
    number = F.col("c_custkey")
    text = number.cast("string")
    ids = membership.requested_ids(
        fn.id_list(F.when(number % 3 != 0, F.concat(text, F.lit("|1,5")))),
        F.when(number % 4 != 0, fn.id_list(F.concat(F.lit("7,"), text))),
    )
    return t.base("customer").select(
        number.alias("user_id"), F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids")
    )


@query
def membership_sync_groups_brands(t: Tables) -> DataFrame:
    """Brands of groups: copies are not touched."""
    number = F.col("brand_id")
    desired = t.groups_brands.where(number % 5 != 0).unionByName(
        t.brands.where(number % 10 == 0).select((number % 25).alias("group_id"), "brand_id")
    )
    changes = membership.membership_changes(t.groups_brands, desired, "group_id", "brand_id")
    return membership.apply_changes(t.groups_brands, changes, "group_id", "brand_id")


@query
def membership_sync_groups_users(t: Tables) -> DataFrame:
    """Users of groups: leaving a group is leaving its copies."""
    # Groups that are five apart and have one content type are copies.
    groups = t.groups.withColumn(
        "name", F.concat(F.lit("G"), (F.col("group_id") % 10).cast("string"))
    )
    current = t.users_groups.select("group_id", "user_id")
    desired = current.where((F.col("user_id") + F.col("group_id")) % 4 != 0)
    changes = membership.membership_changes(
        current, desired, "group_id", "user_id", groups, duplicates_of="group_id"
    )
    return membership.apply_changes(current, changes, "group_id", "user_id")


@query
def membership_clear(t: Tables) -> DataFrame:
    owners = t.users.where(F.col("is_active") == False)  # noqa: E712
    return membership.clear_content_type(
        t.users_brands, owners, t.brands, "user_id", "brand_id", "Live"
    )


@query
def role_upsert(t: Tables) -> DataFrame:
    changes = t.users.where(F.col("user_id") % 6 == 0).select(
        "user_id", (F.col("user_id") % 5 + 1).alias("role_id")
    )
    current = t.users_roles.where(F.col("user_id") % 4 != 0)
    return membership.upsert_single(current, changes, "user_id")


def _group_changes(t: Tables) -> DataFrame:
    """A log with an entry per customer: conflicting updates, names given up and asked for, blanks."""
    number, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    old_name = F.concat(F.lit(" "), F.col("n_name"), F.lit("  "))
    nations = t.base("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.base("customer").join(nations, "c_nationkey").select(
        # Not in the order of the numbers, and unique.
        (number * 7919 % 1000003).alias("seq"),
        F.when(number % 3 == 0, number % 31).when(number % 3 == 1, -number).alias("group_id"),
        F.when(number % 3 == 0, F.when(number % 4 != 0, F.concat(F.lit("Renamed "), (number % 40).cast("string"))))
        .when(number % 7 == 0, "  ")
        .when(number % 7 == 1, F.concat(F.lit("Renamed "), (number % 40).cast("string")))
        .when(number % 2 == 0, old_name)
        .otherwise(F.concat(F.lit(" New "), (number % 11).cast("string"), F.lit(" ")))
        .alias("name"),
        F.when((number % 3 != 0) | (number % 5 == 0), F.when(nation % 2 == 0, "Live").otherwise("OnDemand"))
        .alias("content_type"),
    )


def _group_upsert(t: Tables) -> tuple[DataFrame, DataFrame]:
    return upserts.upsert_rows(
        t.groups, _group_changes(t), "group_id", ["name", "content_type"], "name", "seq"
    )


@query
def group_upsert(t: Tables) -> DataFrame:
    return _group_upsert(t)[0]


@query
def group_upsert_rejects(t: Tables) -> DataFrame:
    return _group_upsert(t)[1]


def _user_upsert(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A log with an entry per customer, on users with two kinds of stamps."""
    stamped = t.users.select(
        "user_id", "name", "email", "is_active",
        F.lit(dt.date(2020, 1, 1)).alias("creation_date"), F.lit(1).cast("long").alias("created_by_id"),
        F.lit(None).cast("date").alias("modification_date"), F.lit(None).cast("long").alias("modified_by_id"),
    )
    number = F.col("c_custkey")
    text = number.cast("string")
    of_other = F.concat(
        F.lit("u"), F.call_function("div", number, F.lit(4)).cast("string"), F.lit("@"),
        F.lower("c_mktsegment"), F.lit(".example"),
    )
    log = t.base("customer").select(
        (number * 7919 % 1000003).alias("seq"),
        F.when(number % 4 == 0, number % 97).when(number % 4 == 1, number + 900000000).alias("user_id"),
        F.when(number % 5 != 0, F.concat(F.lit("Name "), text)).alias("name"),
        F.when(number % 8 == 0, F.concat(F.lit("moved"), text, F.lit("@x.example")))
        .when(number % 4 == 2, F.when(number % 6 != 0, F.concat(F.lit(" n"), (number % 50).cast("string"), F.lit("@x.example "))))
        .when(number % 4 == 3, of_other)
        .alias("email"),
        (number % 3 == 0).alias("is_active"),
    )
    today = F.lit(star_schema.AS_OF)
    return upserts.upsert_rows(
        stamped, log, "user_id", ["email"], "email", "seq",
        created={"creation_date": today, "created_by_id": F.lit(42).cast("long")},
        modified={"modification_date": today, "modified_by_id": F.lit(42).cast("long")},
    )


@query
def user_upsert(t: Tables) -> DataFrame:
    return _user_upsert(t)[0]


@query
def user_upsert_rejects(t: Tables) -> DataFrame:
    return _user_upsert(t)[1]


@query
def created_group_ids(t: Tables) -> DataFrame:
    """Groups of the log that are new, with ids from the highest one on."""
    return _group_upsert(t)[0].join(t.groups.select("group_id"), "group_id", "left_anti")
