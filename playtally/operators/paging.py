"""Total orders and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_order(df: DataFrame, keys: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort expressions for ``(column, 'asc' | 'desc')`` keys.

    Nulls count as the largest value, as in the warehouse. All other columns
    break ties: pages are repeatable, and rows that share the leading keys can
    still be range-partitioned over many tasks.
    """
    named = [name for name, _ in keys]
    rest = [(name, "asc") for name in df.columns if name not in named]
    return [_sort(name, direction) for name, direction in [*keys, *rest]]


def ordered(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*total_order(df, keys))


def page(
    df: DataFrame, keys: Sequence[tuple[str, str]], number: int = 1, size: int = 100
) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows, by offset.

    A page costs as many rows per task as lie before its end; walk far into a
    result with :func:`page_after` instead.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return ordered(df, keys).offset((number - 1) * size).limit(size)


def page_after(
    df: DataFrame,
    keys: Sequence[tuple[str, str]],
    last_row: dict[str, object] | None,
    size: int = 100,
) -> DataFrame:
    """The ``size`` rows that follow ``last_row`` of the page before.

    The position is a filter, so every page costs the same however deep it is.
    """
    if last_row is not None:
        df = df.where(_follows(df, keys, last_row))
    return ordered(df, keys).limit(size)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows of all pages."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def first_row(df: DataFrame, key: str) -> DataFrame:
    """Row with the lowest key."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(1)


def _sort(name: str, direction: str) -> Column:
    if direction.lower() == "asc":
        return F.col(name).asc_nulls_last()
    if direction.lower() == "desc":
        return F.col(name).desc_nulls_first()
    raise ValueError(f"unknown sort direction {direction!r}")


def _follows(
    df: DataFrame, keys: Sequence[tuple[str, str]], last_row: dict[str, object]
) -> Column:
    named = [name for name, _ in keys]
    all_keys = [*keys, *[(name, "asc") for name in df.columns if name not in named]]
    result = F.lit(False)
    tied = F.lit(True)
    for name, direction in all_keys:
        column, value = F.col(name), last_row[name]
        result = result | (tied & _beyond(column, value, direction.lower() == "asc"))
        tied = tied & column.eqNullSafe(F.lit(value))
    return result


def _beyond(column: Column, value: object, ascending: bool) -> Column:
    """Strictly later in the order, with null as the largest value."""
    if value is None:
        return F.lit(False) if ascending else column.isNotNull()
    later = column > F.lit(value) if ascending else column < F.lit(value)
    reach_null = column.isNull() if ascending else F.lit(False)
    return F.coalesce(later, F.lit(False)) | reach_null
