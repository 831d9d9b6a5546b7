"""Completion flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shares (in percent) that have a flag. A share is passed
# when more than it was viewed; the last one also when exactly it was viewed.
COMPLETION_SHARES = (25, 50, 75, 95, 100)


def completion_flags(duration: Column, viewed: Column) -> dict[str, Column]:
    """``pctN_viewed`` flags (0/1) from seconds of duration and seconds viewed.

    The percentage is compared by cross-multiplication in whole seconds: it is
    exact, never divides by zero and stays in primitive longs, where decimal
    division would box every value.
    """
    length = duration.cast("long")
    seen = viewed.cast("long")
    # A negative length turns the comparison round.
    scaled = F.when(length < 0, seen * -100).otherwise(seen * 100)
    known = F.coalesce(length != 0, F.lit(False)) & seen.isNotNull()
    flags = {}
    for share in COMPLETION_SHARES:
        bar = F.abs(length) * share
        passed = scaled >= bar if share == 100 else scaled > bar
        flags[f"pct{share}_viewed"] = F.when(known & passed, 1).otherwise(0)
    return flags
