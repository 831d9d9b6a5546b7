"""Text search by an index of trigrams, with the same result as a scan by pattern.

The index has one row per (column, trigram, row id): three neighbouring characters of a text in lower case.
It is built once and written in the order of the trigrams, so a search reads the few row groups that hold those of
its pattern. A frequent trigram is spread over files by row id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.functions import like
from playtally.operators.stacking import stack

SIZE = 3


def trigrams(text: Column) -> Column:
    """The different trigrams of a text, folded as a pattern match folds it; none of null."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(
        F.length(folded) >= SIZE, F.sequence(F.lit(1), F.length(folded) - SIZE + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(folded, i, F.lit(SIZE))))


def build_index(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, trigram, ``key``) of all texts; ids must be unique."""
    return stack(
        [
            rows.select(F.lit(c).alias("column"), F.explode(trigrams(F.col(c))).alias("trigram"), key)
            for c in columns
        ]
    )


def write_index(index: DataFrame, path: str) -> None:
    """Write an index in the order in which searches read it."""
    order = index.columns
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pattern_trigrams(pattern: str) -> list[str]:
    """Trigrams that every match of a pattern has.

    They lie in stretches of plain characters between wildcards. Characters beyond
    ASCII are passed over here, as their lower case may depend on their neighbours.
    """
    runs, run, rest = [], "", iter(pattern)
    for char in rest:
        is_wildcard = char in "%_"
        if char == "\\":
            char = next(rest, "")
        if is_wildcard or not char.isascii():
            runs.append(run)
            run = ""
        else:
            run += char.lower()
    return sorted({x[i : i + SIZE] for x in [*runs, run] for i in range(len(x) - SIZE + 1)})


def candidates(index: DataFrame, key: str, column: str, pattern: str) -> DataFrame | None:
    """Ids of the rows that have all trigrams of a pattern; None where it has none."""
    wanted = pattern_trigrams(pattern)
    if not wanted:
        return None
    found = index.where((F.col("column") == column) & F.col("trigram").isin(wanted))
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(key)


def search(
    rows: DataFrame, index: DataFrame, key: str, patterns: dict[str, str], every: bool = True
) -> DataFrame:
    """Rows whose columns match their patterns, all or at least one of them.

    Candidates of the index are verified by the patterns. A pattern without three plain characters in a row has no
    candidates: of patterns that must all match, the others choose; else the rows are scanned.
    """
    tests = [like(F.col(c), p) for c, p in patterns.items()]
    chosen = [candidates(index, key, c, p) for c, p in patterns.items()]
    if every:
        for found in chosen:
            if found is not None:
                rows = rows.join(found, key, "left_semi")
        for test in tests:
            rows = rows.where(test)
        return rows
    either = tests[0]
    for test in tests[1:]:
        either = either | test
    if all(found is not None for found in chosen):
        rows = rows.join(stack(chosen), key, "left_semi")
    return rows.where(either)
