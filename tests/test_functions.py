import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally import functions as fn


def test_event_day_crosses_both_clock_changes(column):
    stamps = [1678604399000, 1678586400000, 1699164000000, 1719806399999, 1719806400000]
    days = [
        dt.date(2023, 3, 12), dt.date(2023, 3, 11), dt.date(2023, 11, 5),
        dt.date(2024, 6, 30), dt.date(2024, 7, 1),
    ]
    # 2023-03-12 01:59:59 and 2023-03-11 21:00:00 local, then summer time.
    assert column(stamps, "bigint", fn.event_day) == days


def test_local_day_start_and_length(column):
    days = [dt.date(2023, 2, 19), dt.date(2023, 3, 12)]
    assert column(days[:1], "date", fn.local_day_start) == [1676782800]
    length = lambda x: fn.local_day_start(F.date_add(x, 1)) - fn.local_day_start(x)
    assert column(days, "date", length) == [86_400, 82_800]


def test_on_local_day_is_half_open(column):
    start = 1676782800
    inside = lambda x: fn.on_local_day(x, dt.date(2023, 2, 19))
    moments = [start - 1, start, start + 86_399, start + 86_400]
    assert column(moments, "bigint", inside) == [False, True, True, False]


def test_date_keys(column):
    assert column([dt.date(2023, 1, 31)], "date", fn.date_key) == [20230131]
    assert column(["2023-01-31"], "string", fn.key_of_day_text) == [20230131]
    key_utc = lambda x: fn.date_key(fn.local_day(x, "UTC"))
    assert column([1675167722], "bigint", key_utc) == [20230131]


def test_period_start(column):
    day = [dt.date(2024, 1, 17)]
    starts = {"daily": day[0], "weekly": dt.date(2024, 1, 15), "monthly": dt.date(2024, 1, 1)}
    for grain, start in starts.items():
        assert column(day, "date", lambda x, g=grain: fn.period_start(x, g)) == [start]
    with pytest.raises(ValueError):
        fn.period_start(F.lit(None), "hourly")


def test_platform_bucket_is_case_sensitive(column):
    names = ["ios", "android", "chromecast", "firetv", "IOS", "", None]
    assert column(names, "string", fn.platform_bucket) == [
        "Mobile", "Mobile", "Connected", "Connected", "Web", "Web", "Web"
    ]


def test_blank_conventions(column):
    assert column([None, "", " ", "x"], "string", fn.blank_to_na) == ["N/A", "N/A", " ", "x"]
    assert column(["N/A", "x", None], "string", fn.na_to_null) == [None, "x", None]
    assert column([None, 0, 7], "bigint", fn.zero_if_blank) == [0, 0, 7]


def test_product_label(column):
    types = ["introtv", "IntroTV", "", None, "x"]
    assert column(types, "string", fn.product_label) == ["NOW TV", "NOW TV", "TVE", "TVE", "TVE"]


@pytest.mark.parametrize(
    ("duration", "viewed", "flags"),
    [
        (400, 100, "00000"), (400, 101, "10000"), (400, 200, "10000"), (400, 201, "11000"),
        (400, 301, "11100"), (400, 380, "11100"), (400, 381, "11110"), (400, 399, "11110"),
        (400, 400, "11111"), (0, 10, "00000"), (None, 10, "00000"), (400, None, "00000"),
        (400, 0, "00000"), (-400, -101, "10000"), (-400, 101, "00000"), (3, 1, "10000"),
    ],
)
def test_completion_flags(spark, duration, viewed, flags):
    df = spark.createDataFrame([(duration, viewed)], "d bigint, v bigint")
    row = df.select(
        *[c.alias(n) for n, c in fn.completion_flags(F.col("d"), F.col("v")).items()]
    ).first()
    assert "".join(str(v) for v in row) == flags


def test_id_list(column):
    texts = ["8919|8919,186|186,9218|9218", "46,34", "", None, "x, -3|4"]
    assert column(texts, "string", fn.id_list) == [
        [8919, 186, 9218], [46, 34], [0], [0], [0, -3]
    ]


def test_word_list(column):
    words = lambda x: fn.word_list(x, ["Web", "Mobile"])
    assert column(["Web, Mobile Connected", "", None, " ,"], "string", words) == [
        ["Web", "Mobile", "Connected"], ["Web", "Mobile"], ["Web", "Mobile"], ["Web", "Mobile"]
    ]


def test_natural_key_order(spark):
    names = ["Brand 10", "brand 2", "A&E", "2nd", "10th", "Brand 0010x", "a 9" + 22 * "9", "a 10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    ordered = [r.n for r in df.orderBy(fn.natural_key(F.col("n"))).collect()]
    assert ordered == [
        "2nd", "10th", "A&E", "a 10", "a 9" + 22 * "9", "brand 2", "Brand 10", "Brand 0010x"
    ]


def test_labels(column):
    assert column(["a", None], "string", lambda x: fn.named_label(x, F.lit(7))) == ["a(7)", "(7)"]
    assert column(["a"], "string", lambda x: fn.display_label(x, F.lit("e"))) == ["a (e)"]
    assert column([True, False, None], "boolean", fn.yes_no) == ["Yes", "No", "No"]


def test_predicates(column):
    texts = ["Drama 50%", "drama", None]
    assert column(texts, "string", lambda x: fn.contains(x, "RAM")) == [True, True, None]
    # Wildcards in the text are not escaped.
    assert column(texts, "string", lambda x: fn.contains(x, "d_a")) == [True, True, None]
    assert column(texts, "string", lambda x: fn.matches(x, "DRAMA")) == [False, True, None]
    # A backslash makes the next character literal, also at the end of the text.
    assert column(["50%", "50x", "ab"], "string", lambda x: fn.contains(x, "0\\%")) == [
        True, False, False
    ]
    assert column(["ab", "a\\b"], "string", lambda x: fn.contains(x, "a\\b")) == [True, False]
    assert column(["ab", "a\\b"], "string", lambda x: fn.contains(x, "a\\\\b")) == [False, True]
    assert column(["a%", "ab"], "string", lambda x: fn.contains(x, "a\\")) == [True, False]
    assert column(texts, "string", lambda x: fn.in_list(x, [])) == [False, False, False]
    assert column(["a%b", "axb"], "string", lambda x: fn.same_text(x, "A%B")) == [True, False]
    any_of = lambda x: fn.contains_any(x, ["%50%", "%zz%"])
    assert column(texts[:2], "string", any_of) == [True, False]


def test_content_type_wildcard_in_any_case(column):
    types = ["Live", "OnDemand", None]
    for wanted in ("all", "ALL"):
        assert column(types, "string", lambda x, w=wanted: fn.content_type_matches(x, w)) == [
            True, True, False
        ]
    assert column(types, "string", lambda x: fn.content_type_matches(x, "LIVE")) == [
        True, False, None
    ]
    with pytest.raises(ValueError):
        fn.content_type_matches(F.lit(None), "radio")


def test_all_of(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Anna")], "id int, name string")
    kept = df.where(fn.all_of([("name", "ILIKE", "an%"), ("id", ">", 1)])).collect()
    assert [r.id for r in kept] == [3]
    assert [r.id for r in df.where(fn.all_of([("name", "in", ["Bob"])])).collect()] == [2]
    assert df.where(fn.all_of([])).count() == 3
    with pytest.raises(ValueError):
        fn.all_of([("id", "; drop", 1)])
