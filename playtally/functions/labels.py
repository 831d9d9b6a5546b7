"""Labels and null conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder of a missing text attribute.
NOT_AVAILABLE = "N/A"

# Device platform -> reporting platform; any other is Web.
PLATFORM_BUCKETS = {
    "ios": "Mobile",
    "android": "Mobile",
    "chromecast": "Connected",
    "firetv": "Connected",
}
OTHER_PLATFORM = "Web"

# The user type that marks the second product, the default
# product, and the second product's label on screen and in exports.
SECOND_PRODUCT_USER_TYPE = "introtv"
DEFAULT_PRODUCT = "TVE"
SECOND_PRODUCT_ON_SCREEN = "NOWTV"
SECOND_PRODUCT_IN_EXPORTS = "NOW TV"


def blank_to_na(value: Column) -> Column:
    """Null or empty text becomes the placeholder; blanks are kept."""
    return F.when(value.isNull() | (value == ""), NOT_AVAILABLE).otherwise(value)


def na_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(NOT_AVAILABLE))


def zero_if_blank(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def platform_bucket(platform: Column) -> Column:
    """Reporting platform; the match is case-sensitive."""
    result = None
    for bucket in dict.fromkeys(PLATFORM_BUCKETS.values()):
        members = [name for name, to in PLATFORM_BUCKETS.items() if to == bucket]
        test = platform.isin(members)
        result = F.when(test, bucket) if result is None else result.when(test, bucket)
    return result.otherwise(OTHER_PLATFORM)


def product_label(user_type: Column, second: str = SECOND_PRODUCT_IN_EXPORTS) -> Column:
    """Product of a row: anything but the second product's user type is default."""
    is_second = F.lower(user_type) == SECOND_PRODUCT_USER_TYPE
    return F.when(is_second, second).otherwise(DEFAULT_PRODUCT)


def yes_no(condition: Column) -> Column:
    """'Yes' when true, 'No' when false or null."""
    return F.when(condition, "Yes").otherwise("No")


def named_label(name: Column, number: Column) -> Column:
    """``name(id)``; a missing part counts as empty text."""
    return F.concat(_text(name), F.lit("("), _text(number), F.lit(")"))


def display_label(name: Column, email: Column) -> Column:
    """``name (email)``; a missing part counts as empty text."""
    return F.concat(_text(name), F.lit(" ("), _text(email), F.lit(")"))


def content_type_matches(column: Column, wanted: str) -> Column:
    """Case-insensitive content type test; 'all' in any case keeps every row."""
    if wanted.lower() not in ("ondemand", "live", "all"):
        raise ValueError(f"unknown content type {wanted!r}")
    if wanted.lower() == "all":
        # The wildcard is a pattern match, so it does not match null.
        return column.isNotNull()
    return F.lower(column) == wanted.lower()


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))
