"""Column expressions: every function takes columns and returns a column."""

from playtally.functions.labels import (
    blank_to_na,
    content_type_matches,
    display_label,
    named_label,
    na_to_null,
    platform_bucket,
    product_label,
    yes_no,
    zero_if_blank,
)
from playtally.functions.lists import id_list, natural_key, natural_order, word_list
from playtally.functions.metrics import completion_flags
from playtally.functions.predicates import (
    all_of,
    contains,
    contains_any,
    in_list,
    like,
    matches,
    same_text,
)
from playtally.functions.time import (
    EVENT_ZONE,
    date_key,
    day_of_epoch_ms,
    event_day,
    first_request_day,
    key_of_day_text,
    last_request_day,
    local_day,
    local_day_start,
    on_local_day,
    period_start,
)

__all__ = [
    "EVENT_ZONE",
    "all_of",
    "blank_to_na",
    "completion_flags",
    "contains",
    "contains_any",
    "content_type_matches",
    "date_key",
    "day_of_epoch_ms",
    "display_label",
    "event_day",
    "first_request_day",
    "id_list",
    "in_list",
    "key_of_day_text",
    "last_request_day",
    "like",
    "local_day",
    "local_day_start",
    "matches",
    "na_to_null",
    "named_label",
    "natural_key",
    "natural_order",
    "on_local_day",
    "period_start",
    "platform_bucket",
    "product_label",
    "same_text",
    "word_list",
    "yes_no",
    "zero_if_blank",
]
