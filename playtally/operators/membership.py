"""Bridge tables brought to a desired state, as one set-based job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtally.functions import id_list
from playtally.operators.stacking import stack

INSERT = "insert"
DELETE = "delete"


def desired_links(requests: DataFrame, key: str, ids: str, member: str) -> DataFrame:
    """Rows of (key, array of ids) -> one desired link per id."""
    return requests.select(key, F.explode(ids).alias(member)).distinct()


def requested_ids(*lists: Column) -> Column:
    """Several id arrays as one."""
    return F.concat(*[F.coalesce(ids, F.array().cast("array<bigint>")) for ids in lists])


def membership_diff(
    current: DataFrame,
    desired: DataFrame,
    left: str,
    right: str,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Links to insert and to delete: (action, left, right).

    ``scope`` names the owners (column ``left``) that are edited; all others
    keep their links. Both link sets are stacked and grouped by pair, which
    takes one shuffle and collapses copies of a link before it.
    """
    states = _states(current, desired, left, right, scope)
    changed = states.where(F.col("is_current") != F.col("is_wanted"))
    return changed.select(
        F.when(F.col("is_wanted"), INSERT).otherwise(DELETE).alias("action"), left, right
    )


def expand_deletes(
    links: DataFrame,
    diff: DataFrame,
    dimension: DataFrame,
    left: str,
    right: str,
    duplicates_of: str | None = None,
) -> DataFrame:
    """All existing links that the deletes of a diff take along.

    Deleting a link deletes those to every duplicate of its member, a row of
    ``dimension`` with the same name and content type. Links and deletes meet
    on the owner and the name, so copies are never paired with each other.
    ``duplicates_of`` is the side that has duplicates, ``right`` by default.
    """
    side = duplicates_of or right
    other = left if side == right else right
    names = dimension.select(side, "name", "content_type")
    removed = (
        diff.where(F.col("action") == DELETE)
        .join(names, side)
        .select(other, "name", "content_type")
        .distinct()
    )
    keys = [other, "name", "content_type"]
    return (
        links.select(left, right)
        .join(names, side)
        .join(removed, keys, "left_semi")
        .select(left, right)
        .distinct()
    )


def membership_changes(
    current: DataFrame,
    desired: DataFrame,
    left: str,
    right: str,
    dimension: DataFrame | None = None,
    scope: DataFrame | None = None,
    duplicates_of: str | None = None,
) -> DataFrame:
    """Net changes of a sync: (action, left, right).

    ``scope`` names the owners that are edited. With a column ``content_type`` it
    names the owners and the content types that are edited for them: links to
    members of other types, and to members that the ``dimension`` does not have,
    are neither added nor removed.

    With a ``dimension``, whose ids are unique, deletes reach its duplicates.
    Deletes run after inserts, so a new link to a duplicate of a removed member
    is not kept. The copies of a member that one owner is linked to meet on the owner
    and the name of the member, which takes one shuffle of the states.
    """
    if dimension is None:
        return membership_diff(current, desired, left, right, scope)
    side = duplicates_of or right
    owner = left if side == right else right
    names = dimension.select(side, "name", "content_type")
    by_type = scope is not None and "content_type" in scope.columns
    owners = scope.select(left).distinct() if by_type else scope
    states = _states(current, desired, left, right, owners).join(names, side, "left")
    if by_type:
        edited = scope.select(left, "content_type").distinct()
        states = states.join(edited, [left, "content_type"], "left_semi")
    # A removed link whose member is missing from the dimension has no copies.
    alone = F.when(F.col("name").isNull() | F.col("content_type").isNull(), F.col(side))
    copies = Window.partitionBy(owner, "name", "content_type", alone)
    is_removed = F.col("is_current") & ~F.col("is_wanted")
    is_gone = F.bool_or(is_removed).over(copies)
    marked = states.withColumn("is_gone", is_gone)
    delete = F.col("is_current") & F.col("is_gone")
    insert = ~F.col("is_current") & ~F.col("is_gone")
    return marked.where(delete | insert).select(
        F.when(insert, INSERT).otherwise(DELETE).alias("action"), left, right
    )


def sync_from_lists(
    current: DataFrame,
    requests: DataFrame,
    lists: dict[str, str],
    left: str,
    right: str,
    dimension: DataFrame,
) -> DataFrame:
    """New bridge table after owners have sent lists of member ids as text.

    ``lists`` maps a column of ``requests`` to the content type it edits. A list replaces
    the owner's links to members of that type; a null leaves them alone, and a list
    without any known id takes them all. Ids of another type or of no member are
    passed over. The lists of several requests of one owner count together.
    """
    asked = []
    for column, content_type in lists.items():
        ids = F.explode(id_list(F.col(column))).alias(right)
        own = requests.where(F.col(column).isNotNull())
        asked.append(own.select(left, ids, F.lit(content_type).alias("content_type")))
    wanted = stack(asked).join(dimension.select(right, "content_type"), [right, "content_type"], "left_semi")
    edited = [F.when(F.col(column).isNotNull(), F.lit(kind)) for column, kind in lists.items()]
    scope = (
        requests.select(left, F.explode(F.array(*edited)).alias("content_type"))
        .where(F.col("content_type").isNotNull())
        .distinct()
    )
    changes = membership_changes(
        current, wanted.select(left, right).distinct(), left, right, dimension, scope
    )
    return apply_changes(current, changes, left, right)


def clear_content_type(
    links: DataFrame,
    owners: DataFrame,
    dimension: DataFrame,
    left: str,
    right: str,
    content_type: str,
) -> DataFrame:
    """Bridge table without the owners' links to members of a content type."""
    cleared = dimension.where(F.col("content_type") == content_type).select(right)
    doomed = (
        links.join(owners.select(left), left, "left_semi")
        .join(cleared, right, "left_semi")
        .select(left, right)
        .distinct()
    )
    return links.join(doomed, [left, right], "left_anti")


def apply_changes(
    current: DataFrame, changes: DataFrame, left: str, right: str
) -> DataFrame:
    """New bridge table: current links and changes, one row per link."""
    stacked = current.select(left, right, F.lit(False).alias("gone")).unionByName(
        changes.select(left, right, (F.col("action") == DELETE).alias("gone"))
    )
    return (
        stacked.groupBy(left, right)
        .agg(F.bool_or("gone").alias("gone"))
        .where(~F.col("gone"))
        .select(left, right)
    )


def upsert_single(
    links: DataFrame, changes: DataFrame, left: str, order: str | None = None
) -> DataFrame:
    """Bridge table in which each changed owner has just the new member.

    Of several changes of one owner the last by ``order`` counts; of those that
    tie, and where there is no order, the one with the greatest values.
    """
    own = F.struct(*([order] if order else []), *links.columns)
    last = changes.groupBy(left).agg(F.max(own).alias("last"))
    kept = links.join(changes.select(left), left, "left_anti")
    return kept.unionByName(last.select(*[F.col("last")[c].alias(c) for c in links.columns]))


def _states(
    current: DataFrame, desired: DataFrame, left: str, right: str, scope: DataFrame | None
) -> DataFrame:
    """Every current or wanted link once, with both flags."""
    if scope is not None:
        owners = scope.select(left).distinct()
        current = current.join(owners, left, "left_semi")
        desired = desired.join(owners, left, "left_semi")
    stacked = current.select(left, right, F.lit(False).alias("wanted")).unionByName(
        desired.select(left, right, F.lit(True).alias("wanted"))
    )
    return stacked.groupBy(left, right).agg(
        F.bool_or(~F.col("wanted")).alias("is_current"),
        F.bool_or("wanted").alias("is_wanted"),
    )
