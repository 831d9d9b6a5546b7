"""Delimited lists and natural ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_list(text: Column) -> Column:
    """Comma list -> array of the leading 64-bit integer of each item, 0 if none or too large.

    ``"8919|8919,186"`` gives ``[8919, 186]`` and empty text gives ``[0]``.
    """
    def leading_integer(item: Column) -> Column:
        digits = F.regexp_extract(item, r"^\s*([+-]?\d+)", 1)
        return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), ","), leading_integer)


def word_list(text: Column, default: list[str]) -> Column:
    """Items between blanks and commas; ``default`` when there is none."""
    words = F.filter(F.split(text, r"[\s,]+"), lambda word: word != "")
    fallback = F.array(*[F.lit(item) for item in default])
    return F.when(F.size(F.coalesce(words, F.array())) > 0, words).otherwise(fallback)


def natural_key(text: Column) -> Column:
    """Sort key that puts "Brand 2" before "brand 10".

    Case and white space are ignored. Every run of digits is written as the
    count of its digits, zero-filled, then the digits, so that plain string
    order compares runs by number and a run still sorts as a digit against
    any other character.
    """
    folded = F.upper(F.regexp_replace(text, r"\s+", ""))
    runs = F.regexp_extract_all(folded, F.lit(r"(\d+|\D+)"), F.lit(1))

    def rank_digits(run: Column) -> Column:
        number = F.regexp_replace(run, r"^0+(?=\d)", "")
        width = F.lpad(F.length(number).cast("string"), 6, "0")
        return F.when(run.rlike(r"^\d"), F.concat(width, number)).otherwise(run)

    return F.array_join(F.transform(runs, rank_digits), "")


def natural_order(text: Column) -> Column:
    """Sort key that puts "Brand 2" before "brand 10": an array of comparable structs.

    Case and white space are ignored. The text is cut behind every run of digits. An
    element has the text before the run, and the number by its count of digits
    without leading zeros and by these digits, so numbers of any length compare
    exactly. A ``0`` behind the text stands for the run: against any other character, a number
    sorts as a digit.
    """
    folded = F.upper(F.regexp_replace(text, r"\s+", ""))
    pieces = F.regexp_extract_all(folded, F.lit(r"\D*\d+|\D+"), F.lit(0))

    def element(piece: Column) -> Column:
        run = F.regexp_extract(piece, r"\d+$", 0)
        digits = F.regexp_replace(run, "^0+", "")
        before = F.regexp_extract(piece, r"^\D*", 0)
        return F.struct(
            F.when(run != "", F.concat(before, F.lit("0"))).otherwise(before).alias("text"),
            F.length(digits).alias("digits"),
            digits.alias("number"),
        )

    return F.transform(pieces, element)
