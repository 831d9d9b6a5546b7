"""Nested user, group and brand documents and option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions import (
    content_type_matches,
    display_label,
    named_label,
    natural_order,
    product_label,
)
from playtally.functions.labels import DEFAULT_PRODUCT, SECOND_PRODUCT_ON_SCREEN
from playtally.operators.nest import CHILDREN_PER_ROW, child, flat_children, nest
from playtally.operators.stacking import stack
from playtally.plans.entitlements import canonical_brands


def user_documents(
    users: DataFrame,
    users_groups: DataFrame,
    groups: DataFrame,
    users_brands: DataFrame,
    brands: DataFrame,
    users_roles: DataFrame,
    roles: DataFrame,
    user_id: int | None = None,
    limit: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """User, role, and brands and groups by content type.

    A user with several roles has the one with the lowest id.
    """
    heads = {
        "profile": _only(users, "user_id", user_id).select(
            "user_id", F.struct("is_active", "name", "email").alias("profile")
        ),
        "role": _only(users_roles, "user_id", user_id)
        .join(roles, "role_id")
        .select("user_id", _role().alias("role")),
    }
    children = _user_children(users_groups, groups, users_brands, brands, user_id)
    nested = nest("user_id", heads, children, limit)
    no_role = F.struct(
        *[F.lit(None).cast(t).alias(n) for n, t in
          (("id", "bigint"), ("name", "string"), ("label", "string"))]
    )
    return nested.select(
        F.col("user_id").alias("id"),
        F.col("profile.is_active").alias("is_active"),
        F.col("profile.name").alias("name"),
        F.col("profile.email").alias("email"),
        F.coalesce("role", no_role).alias("role"),
        "vod_brands", "vod_groups", "live_stream_brands", "live_stream_groups",
        "part", "parts",
    )


def user_children(
    users: DataFrame,
    users_groups: DataFrame,
    groups: DataFrame,
    users_brands: DataFrame,
    brands: DataFrame,
    user_id: int | None = None,
) -> DataFrame:
    """The brands and groups of user documents as rows: user_id, kind, position, id, name, content_type.

    For readers that page through a user's children; a document has the same ones as arrays.
    """
    children = _user_children(users_groups, groups, users_brands, brands, user_id)
    known = [(key, links.join(users.select("user_id"), "user_id", "left_semi"), members) for key, links, members in children]
    return flat_children("user_id", known)


def _user_children(
    users_groups: DataFrame,
    groups: DataFrame,
    users_brands: DataFrame,
    brands: DataFrame,
    user_id: int | None,
) -> list[tuple[str, DataFrame, DataFrame]]:
    return [
        _children(
            _only(users_brands, "user_id", user_id), brands, "brand_id",
            {"vod_brands": "OnDemand", "live_stream_brands": "Live"},
        ),
        _children(
            _only(users_groups, "user_id", user_id), groups, "group_id",
            {"vod_groups": "OnDemand", "live_stream_groups": "Live"},
        ),
    ]


def group_documents(
    groups: DataFrame,
    groups_brands: DataFrame,
    brands: DataFrame,
    users_groups: DataFrame,
    users: DataFrame,
    content_type: str = "all",
    group_id: int | None = None,
    limit: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Group with its brands and users."""
    wanted = _only(groups, "group_id", group_id).where(
        content_type_matches(F.col("content_type"), content_type)
    )
    return _membership_documents(
        "group_id",
        wanted,
        _within(groups_brands, wanted, "group_id", content_type, group_id),
        brands.select("brand_id", _linked_brand("brand_id").alias("brands")),
        _within(users_groups, wanted, "group_id", content_type, group_id),
        users.select("user_id", _member().alias("users")),
        limit,
    )


def brand_documents(
    brands: DataFrame,
    brands_brands: DataFrame,
    users_brands: DataFrame,
    users: DataFrame,
    content_type: str = "all",
    brand_id: int | None = None,
    limit: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Brand with the brands linked to it and its users."""
    wanted = _only(brands, "brand_id", brand_id).where(
        content_type_matches(F.col("content_type"), content_type)
    )
    linked = brands.withColumnRenamed("brand_id", "linked_brand_id")
    return _membership_documents(
        "brand_id",
        wanted,
        _within(brands_brands, wanted, "brand_id", content_type, brand_id),
        linked.select("linked_brand_id", _linked_brand("linked_brand_id").alias("brands")),
        _within(users_brands, wanted, "brand_id", content_type, brand_id),
        users.select("user_id", _member().alias("users")),
        limit,
    )


def user_records(
    users: DataFrame,
    users_groups: DataFrame,
    groups: DataFrame,
    users_brands: DataFrame,
    brands: DataFrame,
    users_roles: DataFrame,
    roles: DataFrame,
    providers: DataFrame,
    providers_brands: DataFrame,
    second_product_brands: DataFrame,
    user_id: int | None = None,
    limit: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Detailed user record: lists, their id texts, providers and products.

    ``second_product_brands`` holds the ``brand_id`` of every brand with
    viewing of the second product, see :func:`second_product_brands`; a user linked
    to one has that product. Users are marked as duplicates by a column ``is_duplicate``;
    where the table has none, nobody is.
    """
    own_brands = _only(users_brands, "user_id", user_id).select("user_id", "brand_id")
    mark = F.col("is_duplicate") if "is_duplicate" in users.columns else F.lit(False)
    is_duplicate = F.coalesce(mark, F.lit(False)).alias("is_duplicate")
    heads = {
        "profile": _only(users, "user_id", user_id).select(
            "user_id", F.struct("name", "email", "is_active", is_duplicate).alias("profile")
        ),
        "nowtv": own_brands.join(
            second_product_brands.select("brand_id"), "brand_id", "left_semi"
        ).select("user_id", F.lit(True).alias("nowtv")),
    }
    # A provider is open to a user once per content type of the brands it
    # shares with the user; the two make up one id.
    provided = (
        providers_brands.select("provider_id", "brand_id")
        .join(brands.select("brand_id", "content_type"), "brand_id")
        .select("brand_id", F.struct("provider_id", "content_type").alias("provided"))
    )
    provider_links = own_brands.join(provided, "brand_id").select("user_id", "provided")
    provider = child(
        "provider_id", "name",
        F.col("provider_id").alias("id"), F.col("name").alias("name"),
    )
    by_type = {"liveStreamProviders": "Live", "vodProviders": "OnDemand"}
    provider_members = stack([
        providers.select(
            F.struct("provider_id", F.lit(wanted).alias("content_type")).alias("provided"),
            provider.alias(kind),
        )
        for kind, wanted in by_type.items()
    ])
    role = child(
        "role_id", "name",
        F.col("role_id").alias("id"), F.col("name").alias("name"),
        F.col("label").alias("label"),
    )
    children = [
        ("role_id", _only(users_roles, "user_id", user_id),
         roles.select("role_id", role.alias("roles"))),
        _children(
            own_brands, brands, "brand_id",
            {"brands": None, "liveStreamBrands": "Live", "vodBrands": "OnDemand"},
        ),
        _children(
            _only(users_groups, "user_id", user_id), groups, "group_id",
            {"groups": None, "liveStreamGroups": "Live", "vodGroups": "OnDemand"},
        ),
        ("provided", provider_links, provider_members),
    ]
    nested = nest("user_id", heads, children, limit)
    has_second = F.coalesce("nowtv", F.lit(False))
    return nested.select(
        F.col("user_id").cast("int").alias("id"),
        F.coalesce("profile.name", F.lit("")).alias("name"),
        F.coalesce("profile.email", F.lit("")).alias("email"),
        F.coalesce("profile.is_active", F.lit(False)).alias("isActive"),
        F.coalesce("profile.is_duplicate", F.lit(False)).alias("isDuplicate"),
        "roles",
        _concat("roles", lambda item: item["name"]).alias("rolesConcat"),
        "brands",
        "liveStreamBrands",
        _concat("liveStreamBrands", _plain_id).alias("liveStreamBrandsConcat"),
        "vodBrands",
        _concat("vodBrands", _double_id).alias("vodBrandsConcat"),
        "groups",
        "liveStreamGroups",
        _concat("liveStreamGroups", _plain_id).alias("liveStreamGroupsConcat"),
        "vodGroups",
        _concat("vodGroups", _plain_id).alias("vodGroupsConcat"),
        # The list of all providers is always empty.
        F.array().cast("array<struct<id:bigint,name:string>>").alias("providers"),
        "liveStreamProviders",
        "vodProviders",
        has_second.alias("nowtv"),
        F.when(has_second, F.array(F.lit(DEFAULT_PRODUCT), F.lit(SECOND_PRODUCT_ON_SCREEN)))
        .otherwise(F.array(F.lit(DEFAULT_PRODUCT)))
        .alias("productOptions"),
        "part",
        "parts",
    )


def second_product_brands(summary: DataFrame, brands: DataFrame) -> DataFrame:
    """``brand_id`` of every brand with viewing of the second product.

    Viewing knows brands by name and content type, so all copies of a brand count.
    """
    product = product_label(F.col("x1_user_type"), SECOND_PRODUCT_ON_SCREEN)
    viewed = (
        summary.where(product == SECOND_PRODUCT_ON_SCREEN)
        .select(F.col("brand").alias("name"), "content_type")
        .distinct()
    )
    return brands.join(viewed, ["name", "content_type"], "left_semi").select("brand_id")


def short_user_records(records: DataFrame) -> DataFrame:
    """The part of a detailed record that a signed-in user gets."""
    return records.select(
        "name", F.col("rolesConcat").alias("roles"), "brands", "liveStreamBrands",
        "liveStreamBrandsConcat", "vodBrands", "vodBrandsConcat", "nowtv",
        "productOptions", "part", "parts",
    )


def brand_options(brands: DataFrame, content_type: str) -> DataFrame:
    """Label and value of the canonical brands, in natural order."""
    _no_wildcard(content_type)
    chosen = canonical_brands(brands, content_type_matches(F.col("content_type"), content_type))
    return _options(chosen, "brand_id")


def group_options(groups: DataFrame, content_type: str) -> DataFrame:
    """Label and value of the groups, in natural order."""
    _no_wildcard(content_type)
    return _options(
        groups.where(content_type_matches(F.col("content_type"), content_type)), "group_id"
    )


def user_options(users: DataFrame) -> DataFrame:
    """Label ``name (email)`` and value of all users, in no order."""
    return users.select(
        display_label(F.col("name"), F.col("email")).alias("label"),
        F.col("user_id").alias("value"),
    )


def _options(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(
        natural_order(F.col("name")).asc_nulls_first(), F.col("name"), F.col(key)
    ).select(F.col("name").alias("label"), F.col(key).alias("value"))


def _no_wildcard(content_type: str) -> None:
    if content_type.lower() not in ("ondemand", "live"):
        raise ValueError(f"unknown content type {content_type!r}")


def _only(df: DataFrame, key: str, value: int | None) -> DataFrame:
    return df if value is None else df.where(F.col(key) == value)


def _within(
    links: DataFrame, parents: DataFrame, key: str, content_type: str, value: int | None
) -> DataFrame:
    """Links of the wanted parents only, when not all are wanted."""
    links = _only(links, key, value)
    if content_type.lower() == "all":
        return links
    return links.join(parents.select(key), key, "left_semi")


def _membership_documents(
    key: str,
    parents: DataFrame,
    brand_links: DataFrame,
    brand_members: DataFrame,
    user_links: DataFrame,
    user_members: DataFrame,
    limit: int,
) -> DataFrame:
    heads = {
        "profile": parents.select(key, F.struct("name", "content_type").alias("profile"))
    }
    children = [
        (brand_members.columns[0], brand_links, brand_members),
        ("user_id", user_links, user_members),
    ]
    return nest(key, heads, children, limit).select(
        F.col(key).alias("id"),
        F.col("profile.name").alias("name"),
        F.col("profile.content_type").alias("content_type"),
        "brands",
        "users",
        "part",
        "parts",
    )


def _role() -> Column:
    return F.struct(
        F.col("role_id").alias("id"), F.col("name").alias("name"), F.col("label").alias("label")
    )


def _children(
    links: DataFrame, dimension: DataFrame, key: str, kinds: dict[str, str | None]
) -> tuple[str, DataFrame, DataFrame]:
    """Children of users; a kind takes one content type, or all with None."""
    item = child(
        key, "name",
        F.col(key).alias("id"), F.col("name").alias("name"),
        F.col("content_type").alias("content_type"),
    )
    columns = [
        (item if wanted is None else F.when(F.col("content_type") == wanted, item)).alias(kind)
        for kind, wanted in kinds.items()
    ]
    return key, links, dimension.select(key, *columns)


def _linked_brand(key: str) -> Column:
    return child(
        key, "name",
        F.col(key).alias("id"),
        named_label(F.col("name"), F.col(key)).alias("name"),
        F.col("content_type").alias("content_type"),
    )


def _member() -> Column:
    return child(
        "user_id", "name",
        F.col("user_id").alias("id"), F.col("name").alias("name"),
        F.col("email").alias("email"), F.col("is_active").alias("active"),
    )


def _concat(kind: str, text) -> Column:
    return F.array_join(F.transform(kind, text), ",")


def _plain_id(item: Column) -> Column:
    return item["id"].cast("string")


def _double_id(item: Column) -> Column:
    number = item["id"].cast("string")
    return F.concat(number, F.lit("|"), number)
