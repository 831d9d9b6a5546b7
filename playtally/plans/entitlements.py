"""Audits of who may see what, and lookups of users, groups and brands."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.functions import (
    all_of,
    contains,
    contains_any,
    in_list,
    natural_order,
    same_text,
    yes_no,
)
from playtally.operators import text_index
from playtally.operators.paging import first_row, ordered, page
from playtally.operators.stacking import stack

# Fixed value: rows of a page of users.
USERS_PAGE_SIZE = 3

# Most blocks that the members, and the contents, of one key are put into.
MEMBER_BLOCKS, CONTENT_BLOCKS = 64, 16

# Most brand ids that go through a sort as one row.
LIST_SIZE = 256


def brands_by_group(
    brands: DataFrame,
    groups: DataFrame,
    groups_brands: DataFrame,
    users_groups: DataFrame,
    users_brands: DataFrame,
    summary: DataFrame,
    since: dt.date,
) -> DataFrame:
    """Every brand with its groups, their user counts and its recent summary rows."""
    group_users = _count(users_groups, ["group_id"], F.lit(1), "count_group_users")
    brand_users = _count(users_brands, ["brand_id"], F.col("user_id"), "count_brand_users")
    brand_rows = _count(
        summary.where(F.col("event_date") >= since).select(
            F.col("brand").alias("name"), "content_type"
        ),
        ["name", "content_type"],
        F.lit(1),
        "count_events_last_90d",
    )
    counted_groups = groups.join(group_users, "group_id", "left").select(
        "group_id",
        F.col("name").alias("group_name"),
        F.col("content_type").alias("group_content_type"),
        "count_group_users",
        F.lit(True).alias("group_known"),
    )
    counted_brands = brands.join(brand_users, "brand_id", "left").join(
        brand_rows, ["name", "content_type"], "left"
    )
    links = groups_brands.select("group_id", "brand_id")
    return (
        counted_brands.join(links, "brand_id", "left")
        .join(counted_groups, "group_id", "left")
        .select(
            _id_if_known("group"),
            "group_name",
            "group_content_type",
            _zero("count_group_users"),
            "brand_id",
            F.col("name").alias("brand_name"),
            F.col("content_type").alias("brand_content_type"),
            _zero("count_brand_users"),
            _zero("count_events_last_90d"),
        )
    )


def providers_with_brands(
    providers: DataFrame, brands: DataFrame, providers_brands: DataFrame
) -> DataFrame:
    """Provider and brand columns of every link between the two."""
    return (
        providers_brands.select("provider_id", "brand_id")
        .join(brands, "brand_id")
        .withColumnsRenamed({"name": "brand_name", "content_type": "brand_content_type"})
        .join(providers.withColumnRenamed("name", "provider_name"), "provider_id")
        .select(
            "provider_id", "provider_name", "brand_id", "brand_name", "brand_content_type"
        )
    )


def brand_activity(summary: DataFrame, since: dt.date) -> DataFrame:
    """First and last day and row count per brand and content type."""
    return (
        summary.where(F.col("event_date") >= since)
        .groupBy("brand", "content_type")
        .agg(
            F.min("event_date").alias("min_event_date"),
            F.max("event_date").alias("max_event_date"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )


def access_by_email(
    users: DataFrame,
    users_groups: DataFrame,
    groups: DataFrame,
    groups_brands: DataFrame,
    brands: DataFrame,
    email_patterns: Iterable[str],
    sort: bool = True,
) -> DataFrame:
    """Groups and, through them, brands of the users whose e-mail matches.

    What a group opens is the same for all its users, so it is put together once per group before
    it meets the users, and rows are made distinct there. Only links to missing groups, which look
    alike, can still give a user the same row twice. Brands of a group that tie in the order but
    for their id come as one list, which is sorted as one row.
    """
    user = ["user_id", "user_email", "user_name", "user_active"]
    group = ["group_id", "group_name", "group_content_type"]
    brand = ["brand_name", "brand_content_type"]
    wanted = users.where(contains_any(F.col("email"), email_patterns)).select(
        "user_id",
        F.col("email").alias("user_email"),
        F.col("name").alias("user_name"),
        F.col("is_active").alias("user_active"),
    ).distinct()
    links = users_groups.select("user_id", "group_id").distinct()
    named_groups = _renamed(groups, "group_id", "group").distinct()
    brand_links = groups_brands.select("group_id", "brand_id").join(
        _renamed(brands, "brand_id", "brand"), "brand_id", "left"
    )
    no_id = F.array(F.lit(None))
    opened = named_groups.join(_brand_lists(brand_links), "group_id", "left").select(
        F.col("group_id").alias("link_id"), *group, "brand_known", *brand,
        F.coalesce("brand_ids", no_id).alias("brand_ids"),
    )
    members = wanted.join(links, "user_id").select(F.col("group_id").alias("link_id"), *user)
    known = _members_with_contents(members, opened, "link_id")
    unknown = (
        wanted.join(links, "user_id", "left")
        .join(named_groups.select("group_id"), "group_id", "left_anti")
        .join(brand_links, "group_id", "left")
        .select(*user, "brand_known", *brand, _id_if_known("brand"))
        .distinct()
        .withColumn("brand_ids", F.array("brand_id"))
    )
    access = known.unionByName(unknown.drop("brand_id"), allowMissingColumns=True)
    order = [("user_name", "asc"), ("brand_name", "asc"), ("brand_content_type", "asc")]
    if sort:
        access = ordered(access, order)
    return access.select(*user, *group, F.explode("brand_ids").alias("brand_id"), *brand)


def legacy_access(
    legacy_users: DataFrame,
    legacy_users_live_groups: DataFrame,
    legacy_live_groups: DataFrame,
    legacy_users_vod_groups: DataFrame,
    legacy_vod_groups: DataFrame,
    email_patterns: Iterable[str],
    sort: bool = True,
) -> DataFrame:
    """Groups of the matching users of the old system, both content types."""
    wanted = legacy_users.where(contains_any(F.col("email"), email_patterns)).select(
        F.col("id").alias("user_id"),
        F.col("email").alias("user_email"),
        F.col("name").alias("user_name"),
        F.col("is_active").alias("user_active"),
    )

    def access(links: DataFrame, groups: DataFrame, content_type: str) -> DataFrame:
        named = groups.select(
            F.col("id").alias("group_id"), F.col("name").alias("group_name"), "description",
            F.lit(True).alias("group_known"),
        )
        return (
            wanted.join(links.select("user_id", "group_id"), "user_id", "left")
            .join(named, "group_id", "left")
            .select(
                "user_id", "user_email", "user_name", "user_active",
                _id_if_known("group"), "group_name",
                F.lit(content_type).alias("group_content_type"),
                "description",
            )
        )

    both = access(legacy_users_live_groups, legacy_live_groups, "Live").unionByName(
        access(legacy_users_vod_groups, legacy_vod_groups, "OnDemand")
    )
    order = [("user_name", "asc"), ("group_name", "asc"), ("description", "asc")]
    return ordered(both, order) if sort else both


def system_comparison(
    users: DataFrame,
    users_roles: DataFrame,
    users_groups: DataFrame,
    users_brands: DataFrame,
    legacy_users: DataFrame,
    legacy_users_roles: DataFrame,
    legacy_users_groups: DataFrame,
    legacy_users_brands: DataFrame,
) -> DataFrame:
    """Links of every user in the new and, by e-mail, in the old system.

    Legacy users that share an e-mail add up. The three link tables of a
    system are counted in one aggregation, so each system costs one join.
    """
    kinds = ["roles", "groups", "explicit_brands"]
    new = _link_counts([users_roles, users_groups, users_brands], kinds, "user_id", "new")
    old_ids = _link_counts(
        [legacy_users_roles, legacy_users_groups, legacy_users_brands], kinds, "id", "old"
    )
    old = (
        legacy_users.select("id", "email")
        .join(old_ids, "id")
        .groupBy("email")
        .agg(*[F.sum(f"old_count_{kind}").alias(f"old_count_{kind}") for kind in kinds])
    )
    counts = [_zero(f"{side}_count_{kind}") for kind in kinds for side in ("old", "new")]
    return (
        users.join(new, "user_id", "left")
        .join(old, "email", "left")
        .select(
            "user_id",
            "name",
            "email",
            yes_no(F.col("is_active")).alias("is_active"),
            yes_no(F.col("password").isNotNull()).alias("password_set"),
            *counts,
        )
    )


def entitled_brands(
    users_brands: DataFrame,
    users_groups: DataFrame,
    groups_brands: DataFrame,
    brands: DataFrame,
    content_types: Iterable[str] | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Brands of every user, or of one: explicit ones and those of the user's groups.

    The content type is filtered before the links of users and groups fan out, and one user's
    links are picked at their scans. Users of the same groups get the same brands, so these are
    made distinct once for each set of groups, and explicit links are left out where the user's
    set has the brand. No row then comes twice, and no row that fans out is shuffled or compared.
    """
    if user_id is not None:
        users_brands = users_brands.where(F.col("user_id") == user_id)
        users_groups = users_groups.where(F.col("user_id") == user_id)
    wanted = brands.select("brand_id", "name", "content_type")
    if content_types is not None:
        wanted = wanted.where(in_list(F.col("content_type"), content_types))
    wanted = wanted.distinct()
    columns = ["user_id", "brand_id", "name", "content_type"]
    opened = groups_brands.select("group_id", "brand_id").join(wanted, "brand_id")
    sets = (
        users_groups.select("user_id", "group_id")
        .join(opened.select("group_id"), "group_id", "left_semi")
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_set("group_id")).alias("groups"))
    )
    opened_by_set = (
        sets.select("groups").distinct()
        .select("groups", F.explode("groups").alias("group_id"))
        .join(opened, "group_id")
        .select("groups", *columns[1:])
        .distinct()
    )
    by_group = _members_with_contents(sets, opened_by_set, "groups")
    explicit = (
        users_brands.select("user_id", "brand_id").distinct()
        .join(wanted, "brand_id")
        .join(
            sets.select(F.col("user_id").alias("member"), "groups"),
            F.col("user_id").eqNullSafe(F.col("member")), "left",
        )
        .join(opened_by_set.select("groups", "brand_id"), ["groups", "brand_id"], "left_anti")
    )
    return explicit.select(*columns).unionByName(by_group.select(*columns))


def canonical_brands(brands: DataFrame, content_type: Column | None = None) -> DataFrame:
    """One brand per name and content type: the one with the lowest id."""
    rows = brands if content_type is None else brands.where(content_type)
    return rows.groupBy("name", "content_type").agg(F.min("brand_id").alias("brand_id"))


def brand_names(brands: DataFrame, brand_ids: Iterable[int]) -> DataFrame:
    """Names of the brands with the given ids, by name."""
    return ordered(
        brands.where(in_list(F.col("brand_id"), brand_ids)).select("brand_id", "name"),
        [("name", "asc")],
    ).select("name")


def find_users(
    users: DataFrame, name: str = "", email: str = "", mode: str = "name"
) -> DataFrame:
    """Users by part of their name or e-mail.

    ``mode='name'`` looks at the name only and wants an e-mail to exist, which
    is what the user search does; ``'both'`` needs both parts to match and
    ``'either'`` one of them.
    """
    by_name = contains(F.col("name"), name)
    by_email = contains(F.col("email"), email)
    tests = {
        "name": by_name & F.col("email").isNotNull(),
        "both": by_name & by_email,
        "either": by_name | by_email,
    }
    return users.where(tests[mode])


def find_users_indexed(
    users: DataFrame, index: DataFrame, name: str = "", email: str = "", mode: str = "name"
) -> DataFrame:
    """:func:`find_users` by an index of the names and e-mails, see `operators.text_index`."""
    if mode == "name":
        users, patterns = users.where(F.col("email").isNotNull()), {"name": f"%{name}%"}
    else:
        patterns = {"name": f"%{name}%", "email": f"%{email}%"}
    return text_index.search(users, index, "user_id", patterns, every=mode != "either")


def rows_where(df: DataFrame, predicates: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Rows of any table that pass every ``(column, operator, value)`` test."""
    return df.where(all_of(predicates))


def users_page(users: DataFrame, number: int = 1, size: int = USERS_PAGE_SIZE) -> DataFrame:
    return page(users, [("user_id", "asc")], number, size)


def user_by_email(users: DataFrame, email: str, is_active: bool = True) -> DataFrame:
    """First user with the e-mail, in any case, and the given activity."""
    found = users.where(same_text(F.col("email"), email) & (F.col("is_active") == is_active))
    return first_row(found, "user_id")


def groups_of_user(users_groups: DataFrame, groups: DataFrame, user_id: int) -> DataFrame:
    links = users_groups.where(F.col("user_id") == user_id).select("group_id")
    return groups.join(links, "group_id", "left_semi")


def roles_in_order(roles: DataFrame, by: str = "name") -> DataFrame:
    """Roles in natural order of their name or label."""
    return roles.orderBy(natural_order(F.col(by)), F.col(by), F.col("role_id"))


def roles_by_name(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Role ids of comma lists of role names: (user_id, roles) -> (user_id, role_id)."""
    names = requests.select("user_id", F.explode(F.split("roles", ",")).alias("name"))
    return names.join(roles.select("name", "role_id"), "name").select(
        "user_id", "role_id"
    ).distinct()


def _count(df: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(what).alias(name))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def _renamed(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.select(
        key,
        F.col("name").alias(f"{prefix}_name"),
        F.col("content_type").alias(f"{prefix}_content_type"),
        F.lit(True).alias(f"{prefix}_known"),
    )


def _id_if_known(prefix: str) -> Column:
    """Id of an outer-joined row; that of a link to a missing row is null."""
    return F.when(F.col(f"{prefix}_known"), F.col(f"{prefix}_id")).alias(f"{prefix}_id")


def _brand_lists(brand_links: DataFrame) -> DataFrame:
    """Ids of the brands of a group by name and content type, in sorted lists of bounded length.

    The id of a missing brand is null, and such brands of a group are one.
    """
    ids = F.when(F.col("brand_known"), F.sort_array(F.collect_set("brand_id"))).otherwise(F.array(F.lit(None)))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(LIST_SIZE))
    lists = F.transform(starts, lambda start: F.slice("ids", start, LIST_SIZE))
    keys = ["group_id", "brand_known", "brand_name", "brand_content_type"]
    return (
        brand_links.groupBy(*keys)
        .agg(ids.alias("ids"))
        .select(*keys, F.explode(lists).alias("brand_ids"))
    )


def _members_with_contents(members: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Every member with every content of its key, by blocks of members and blocks of contents.

    The rows fan out of few small blocks. Adaptive execution sizes tasks by the bytes that they
    read and would leave the rows to few of them, so the pairs of blocks are dealt out by number.
    """
    pairs = _blocks(members, key, "members", MEMBER_BLOCKS).join(
        _blocks(contents, key, "contents", CONTENT_BLOCKS), key
    ).select("members", "contents")
    return (
        pairs.repartition(_tasks(pairs.sparkSession))
        .select("members", F.inline("contents"))
        .select(F.inline("members"), *[name for name in contents.columns if name != key])
    )


def _blocks(df: DataFrame, key: str, block: str, count: int) -> DataFrame:
    """Rows of a key in up to ``count`` arrays of structs."""
    own = [name for name in df.columns if name != key]
    return (
        df.groupBy(key, F.pmod(F.xxhash64(*own), F.lit(count)).alias("number"))
        .agg(F.collect_list(F.struct(*own)).alias(block))
        .select(key, block)
    )


def _tasks(spark: SparkSession) -> int:
    """Tasks for work that the size of its input does not tell."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _link_counts(
    links: list[DataFrame], kinds: list[str], key: str, side: str
) -> DataFrame:
    tagged = [
        df.select(F.col("user_id").alias(key), F.lit(kind).alias("kind"))
        for df, kind in zip(links, kinds, strict=True)
    ]
    return stack(tagged).groupBy(key).agg(
        *[
            F.count_if(F.col("kind") == kind).alias(f"{side}_count_{kind}")
            for kind in kinds
        ]
    )
