"""Column expressions shared by the operators that run on built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\f\r "


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t ... \\r; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, "[\\x20\\x09-\\x0D]+")
    )


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where the body uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(first: int | Column, last: Column) -> Column:
    """first ... last, empty where last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or that with underscores behind it, such that no column has the name in any case."""
    taken = {x.lower() for x in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
