"""Filter predicates."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def contains(column: Column, text: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the text act as wildcards."""
    return like(column, f"%{text}%")


def like(column: Column, pattern: str) -> Column:
    """Case-insensitive pattern match.

    A backslash escapes the next character, whichever that is; Spark alone
    takes it before wildcards and itself only.
    """
    plain = re.sub(
        r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], pattern, flags=re.DOTALL
    )
    return column.ilike(plain)


def contains_any(column: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive match of at least one pattern."""
    return reduce(operator.or_, [like(column, p) for p in patterns], F.lit(False))


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive whole match of a pattern."""
    if "%" in pattern or "_" in pattern or "\\" in pattern:
        return like(column, pattern)
    return F.lower(column) == pattern.lower()


def same_text(column: Column, text: str) -> Column:
    """Case-insensitive equality, without wildcards."""
    return F.lower(column) == text.lower()


def in_list(column: Column, values: Iterable) -> Column:
    """Membership in a list; an empty list keeps no row."""
    values = list(values)
    return column.isin(values) if values else F.lit(False)


def all_of(predicates: Iterable[tuple[str, str, object]]) -> Column:
    """Conjunction of ``(column, operator, value)`` triples."""
    def one(name: str, op: str, value: object) -> Column:
        if op.lower() == "ilike":
            return like(F.col(name), value)
        if op.lower() == "in":
            return in_list(F.col(name), value)
        if op not in _COMPARE:
            raise ValueError(f"unknown operator {op!r}")
        return _COMPARE[op](F.col(name), F.lit(value))

    return reduce(operator.and_, [one(*p) for p in predicates], F.lit(True))
