"""The engine's tables, derived from the star-schema test tables.

Each function takes a session and a folder of parquet files and returns a lazy
frame; the derivations follow FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Run day at which the event tables are looked at.
AS_OF = dt.date(2024, 1, 16)

# The old system numbers its users from here.
LEGACY_OFFSET = 100_000


_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# --- viewing ---------------------------------------------------------------


def assets(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("p_partkey")
    return table(spark, folder, "part").select(
        number.alias("asset_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("series_name"),
        F.col("p_name").alias("episode_name"),
        F.col("p_size").cast("string").alias("episode_number"),
        (number % 8 + 1).cast("string").alias("season_number"),
        F.when(F.col("p_size") <= 25, "Series").otherwise("Movie").alias("program_type"),
        F.when(number % 3 == 0, "TV-G").when(number % 3 == 1, "TV-14").alias("rating"),
        F.lit("1995-01-01").alias("available_date"),
        F.lit("2002-12-31").alias("expiration_date"),
    )


def viewing(spark: SparkSession, folder: str) -> DataFrame:
    """Viewing rows with an asset: order lines with their order and part."""
    line = table(spark, folder, "lineitem")
    order = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand"
    )
    number = F.col("l_partkey")
    return line.join(part, "l_partkey").join(order, "l_orderkey").select(
        F.col("l_shipdate").cast("date").alias("event_date"),
        number.alias("asset_id"),
        F.when(F.col("l_returnflag") == "A", "Web")
        .when(F.col("l_returnflag") == "N", "Mobile")
        .otherwise("Connected")
        .alias("platform"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("l_linestatus") == "O", "OnDemand").otherwise("Live").alias("content_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "IntroTV")
        .when(F.col("o_orderpriority") == "2-HIGH", "")
        .alias("x1_user_type"),
        F.when(number % 5 != 0, F.concat(F.lit("EP"), number.cast("string"))).alias("gracenote_id"),
        F.col("o_custkey").cast("string").alias("device_id"),
        F.concat(F.lit("199"), (number % 10).cast("string"), F.lit("-01-01")).alias("air_date"),
        (F.col("l_quantity") * 100).cast("long").alias("duration_secs"),
        (F.col("l_quantity") * 16 * F.col("l_linenumber")).cast("long").alias("viewed_secs"),
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")
    )
    platform = F.col("event_type")
    day = F.col("ts").cast("date")
    return table(spark, folder, "events").select(
        event,
        F.call_function("div", micros, F.lit(1000)).alias("event_timestamp"),
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day))
        .cast("int")
        .alias("event_datekey"),
        F.when(platform == "click", "ios")
        .when(platform == "view", "android")
        .when(platform == "purchase", "chromecast")
        .when(platform == "error", "firetv")
        .otherwise("web")
        .alias("platform"),
        F.when(event % 2 == 0, "Live").otherwise("On-Demand").alias("entity_type"),
        k.cast("string").alias("program_id"),
        k.cast("string").alias("media_guid"),
        F.col("user_id").cast("string").alias("device_id"),
        F.when(event % 19 == 0, F.lit(None))
        .when(event % 23 == 0, "")
        .otherwise(F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")))
        .alias("company"),
        F.concat(F.lit("Prov#"), (k % 10).cast("string")).alias("provider"),
        F.when(event % 3 == 0, "").otherwise("Ser").alias("series_name"),
        F.lit(None).cast("string").alias("season_number"),
        F.lit("1").alias("episode_number"),
        F.lit("Ep").alias("episode_name"),
        F.lit("2024-01-01").alias("airdate"),
        F.when(event % 17 == 0, F.lit(None))
        .when(event % 13 == 0, 0)
        .otherwise(400)
        .cast("long")
        .alias("duration_secs"),
        F.floor("value").cast("long").alias("viewed_secs"),
        F.when(F.col("user_id") % 5 == 0, "introtv").alias("x1_user_type"),
    )


def _event_assets(spark: SparkSession, folder: str, key: str, entity_type: str) -> DataFrame:
    number = F.col("p_partkey")
    return table(spark, folder, "part").select(
        number.cast("string").alias(key),
        F.lit(entity_type).alias("entity_type"),
        F.when(number % 7 == 0, "")
        .otherwise(F.concat(F.lit("EP"), number.cast("string")))
        .alias("tms_episode_id"),
        F.when(number % 11 != 0, "2024-01-01").alias("last_update"),
    )


def live_assets(spark: SparkSession, folder: str) -> DataFrame:
    return _event_assets(spark, folder, "program_id", "Live")


def ondemand_assets(spark: SparkSession, folder: str) -> DataFrame:
    return _event_assets(spark, folder, "media_guid", "On-Demand")


def live_filtered_devices(spark: SparkSession, folder: str) -> DataFrame:
    return (
        raw_events(spark, folder)
        .where(F.col("entity_type") == "Live")
        .groupBy("device_id", "program_id")
        .agg(((F.count(F.lit(1)) - 1) * 4).alias("program_count"))
        .select(
            "device_id",
            "program_id",
            (F.col("device_id").cast("long") % 2 == 0).alias("time_diff"),
            "program_count",
        )
    )


# --- entitlements ----------------------------------------------------------


def _content_type(number: Column) -> Column:
    return F.when(number % 2 == 0, "Live").otherwise("OnDemand")


def _email() -> Column:
    return F.concat(
        F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@"),
        F.lower("c_mktsegment"), F.lit(".example"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        number.alias("user_id"),
        F.col("c_name").alias("name"),
        _email().alias("email"),
        F.when(number % 13 != 0, F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(number % 4 != 0, "secret").alias("password"),
    )


def groups(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("n_nationkey").cast("long")
    return table(spark, folder, "nation").select(
        number.alias("group_id"),
        F.col("n_name").alias("name"),
        _content_type(number).alias("content_type"),
    )


def brands(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        number.alias("brand_id"),
        F.concat(F.lit("Brand "), (number % 40).cast("string")).alias("name"),
        _content_type(number).alias("content_type"),
    )


def users_groups(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    number, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    first = customer.where(number % 10 != 9).select(
        number.alias("user_id"), nation.alias("group_id")
    )
    second = customer.where(number % 3 == 0).select(
        number.alias("user_id"), ((nation + 7) % 25).alias("group_id")
    )
    return first.unionByName(second)


def groups_brands(spark: SparkSession, folder: str) -> DataFrame:
    nation = F.col("s_nationkey").cast("long")
    return table(spark, folder, "supplier").where(nation % 6 != 0).select(
        nation.alias("group_id"), F.col("s_suppkey").alias("brand_id")
    )


def users_brands(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("brand_id")
    )
    order = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id")
    )
    return line.join(order, "o_orderkey").select("user_id", "brand_id").distinct()


def roles(spark: SparkSession, folder: str) -> DataFrame:
    """The five market segments, numbered alphabetically."""
    return (
        table(spark, folder, "customer")
        .select(F.col("c_mktsegment").alias("name"))
        .distinct()
        .select(
            _role_id(F.col("name")).alias("role_id"),
            "name",
            F.initcap("name").alias("label"),
        )
    )


def users_roles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), _role_id(F.col("c_mktsegment")).alias("role_id")
    )


def _role_id(name: Column) -> Column:
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return F.array_position(F.array(*[F.lit(s) for s in segments]), name).cast("long")


def providers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("long").alias("provider_id"), F.col("r_name").alias("name")
    )


def providers_brands(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"
    )
    return table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.col("n_regionkey").cast("long").alias("provider_id"),
        F.col("s_suppkey").alias("brand_id"),
    )


def brands_brands(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of one nation are not linked; each is to two others by number."""
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("brand_id"))
    number = F.col("brand_id")
    linked = F.filter(
        F.array(F.call_function("div", number, F.lit(2)), F.call_function("div", number, F.lit(3))),
        lambda other: other != number,
    )
    return supplier.where(number % 4 != 3).select(
        "brand_id", F.explode(F.array_distinct(linked)).alias("linked_brand_id")
    )


def legacy_users(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("c_custkey")
    return table(spark, folder, "customer").where(number % 4 != 0).select(
        (number + LEGACY_OFFSET).alias("id"),
        F.col("c_name").alias("name"),
        _email().alias("email"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def _legacy_links(links: DataFrame) -> DataFrame:
    return links.withColumn("user_id", F.col("user_id") + LEGACY_OFFSET)


def legacy_users_brands(spark: SparkSession, folder: str) -> DataFrame:
    return _legacy_links(users_brands(spark, folder).where(F.col("brand_id") % 3 != 0))


def legacy_users_roles(spark: SparkSession, folder: str) -> DataFrame:
    return _legacy_links(users_roles(spark, folder).where(F.col("user_id") % 6 != 0))


def _legacy_groups(spark: SparkSession, folder: str, parity: int) -> DataFrame:
    nation = table(spark, folder, "nation").where(F.col("n_nationkey") % 2 == parity)
    return nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("description"),
    )


def legacy_live_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _legacy_groups(spark, folder, 0)


def legacy_vod_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _legacy_groups(spark, folder, 1)


def legacy_users_live_groups(spark: SparkSession, folder: str) -> DataFrame:
    links = users_groups(spark, folder).where(F.col("group_id") % 2 == 0)
    return _legacy_links(links)


def legacy_users_vod_groups(spark: SparkSession, folder: str) -> DataFrame:
    links = users_groups(spark, folder).where(F.col("group_id") % 2 == 1)
    return _legacy_links(links)


def desired_users_brands(spark: SparkSession, folder: str) -> DataFrame:
    """Target of the membership sync: most current links and some new ones."""
    kept = users_brands(spark, folder).where(
        (F.col("user_id") + F.col("brand_id")) % 7 != 0
    )
    number = F.col("c_custkey")
    added = table(spark, folder, "customer").where(number % 50 == 0).select(
        number.alias("user_id"), (number % 100).alias("brand_id")
    )
    return kept.unionByName(added).distinct()
