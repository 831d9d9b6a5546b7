"""Gapless numbers in a sort order, by two passes of prefix sums.

The rows are range-partitioned and sorted, which spreads them evenly whatever the keys are; rows with
equal keys are told apart by all their other columns. The first pass counts the rows of each range,
and the second adds the rows of all ranges before to the place inside the range. No window runs over all
rows or over one hot group: what one task sees of the whole is one row per range.

Between the passes the sorted rows are checkpointed, as two runs of one range partitioning may cut the
ranges at different rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtally.operators.paging import total_order
from playtally.sources.cuts import materialised

# A row's id has the number of its partition above its place in the partition.
PLACE_BITS = 33


def running_totals(rows: DataFrame, order: str, totals: dict[str, str]) -> DataFrame:
    """Add the sums of columns over all earlier rows of a table with one row per partition.

    ``totals`` maps a column to the name of its sum; the first row has 0.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(name) for c, name in totals.items()]
    return rows.select("*", *sums)


def numbered(
    df: DataFrame, keys: Sequence[tuple[str, str]], name: str = "number", first: int | Column = 0
) -> DataFrame:
    """Number all rows by ``(column, 'asc' | 'desc')`` keys: ``first``, ``first + 1``, ... without gaps.

    Nulls count as the largest value. Equal rows get different numbers; which of
    them gets which makes no difference.
    """
    in_order = df.orderBy(*total_order(df, keys))
    place = F.monotonically_increasing_id()
    placed = materialised(in_order.select("*", place.alias("row_place")))
    placed = placed.withColumn("row_range", F.shiftright("row_place", PLACE_BITS))
    sizes = placed.groupBy("row_range").agg(F.count(F.lit(1)).alias("row_count"))
    bases = running_totals(sizes, "row_range", {"row_count": "row_base"}).drop("row_count")
    within = F.col("row_place").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.join(bases, "row_range").select(
        *df.columns, (F.col("row_base") + within + first).alias(name)
    )


def numbered_within(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[tuple[str, str]],
    name: str = "position",
    first: int = 0,
) -> DataFrame:
    """Number the rows of each group, from ``first`` without gaps.

    One numbering of all rows by group and keys serves every group, so a group of any
    size is spread over as many tasks as it needs; its first number is subtracted.
    """
    in_groups = numbered(df, [*((g, "asc") for g in groups), *keys], "row_number")
    named = [F.col(g).alias(f"row_group_{i}") for i, g in enumerate(groups)]
    starts = in_groups.groupBy(*named).agg(F.min("row_number").alias("row_first"))
    same = [F.col(g).eqNullSafe(F.col(f"row_group_{i}")) for i, g in enumerate(groups)]
    return in_groups.join(starts, same).select(
        *df.columns, (F.col("row_number") - F.col("row_first") + first).alias(name)
    )


def ranked(df: DataFrame, order: Column, name: str = "rank", first: int = 1) -> DataFrame:
    """Give every row the place of its sort key among the different keys; equal keys share it.

    Only the different keys are sorted and numbered, and rows meet them on the key.
    """
    keyed = df.withColumn("rank_key", order)
    places = numbered(keyed.select("rank_key").distinct(), [("rank_key", "asc")], name, first)
    places = places.withColumnRenamed("rank_key", "place_key")
    same = F.col("rank_key").eqNullSafe(F.col("place_key"))
    return keyed.join(places, same).select(*df.columns, name)
