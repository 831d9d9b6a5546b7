"""CSV report files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def with_headings(df: DataFrame, headings: list[str]) -> DataFrame:
    """Rename all columns, by position, to display headings.

    Headings beyond the last column are notes: each becomes an empty column,
    so that every line of the file has as many fields as the header.
    """
    if len(headings) < len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(headings)} headings")
    notes = headings[len(df.columns):]
    blanks = [F.lit(None).cast("string").alias(note) for note in notes]
    return df.toDF(*headings[: len(df.columns)]).select("*", *blanks)


def export_name(first_day: dt.date, last_day: dt.date) -> str:
    """File stem of an export."""
    return f"metrics_{first_day:%Y%m%d}-{last_day:%Y%m%d}"


def write_csv(df: DataFrame, path: str, headings: list[str] | None = None) -> None:
    """Write a report as RFC 4180 part files with a header in each.

    Part files keep the order of a sorted frame, and texts keep their blanks. Nulls and empty texts are
    both written as an empty field, and a backslash before a quote is dropped.
    """
    plain = df.select(
        *[
            F.regexp_replace(F.col(f.name), r'\\"', '"').alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    out = with_headings(plain, headings) if headings else plain
    (
        out.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
