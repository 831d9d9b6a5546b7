import datetime as dt

import pytest

from playtally import params


def test_text_range_end_is_exclusive_unless_last_second():
    first = dt.date(2023, 5, 1)
    assert params.days_from_text("2023-05-01", "2023-05-27") == (first, dt.date(2023, 5, 26))
    assert params.days_from_text("2023-05-01T00:00:00", "2023-05-26T23:59:59") == (
        first, dt.date(2023, 5, 26)
    )
    assert params.days_from_text("2023-05-01T00:00:00+09:00", "2023-05-26T23:59:59-05:00") == (
        first, dt.date(2023, 5, 26)
    )
    assert params.days_from_text("2023-05-01T22:00:00-05:00", "2023-05-03T00:00:00Z") == (
        dt.date(2023, 5, 2), dt.date(2023, 5, 2)
    )


def test_epoch_range():
    # 2022-11-01 00:00:00 and 2022-11-30 23:59:59.
    start, end = "1667260800000", "1669852799999"
    assert params.days_from_epoch_ms(start, end) == (dt.date(2022, 11, 1), dt.date(2022, 11, 30))
    assert params.days_from_epoch_ms(start, 1669852800000) == (
        dt.date(2022, 11, 1), dt.date(2022, 11, 30)
    )
    assert params.days_from_epoch_ms(start, 1669852800000, exclusive_end=False) == (
        dt.date(2022, 11, 1), dt.date(2022, 12, 1)
    )


def test_platforms():
    default = params.EXPORT_PLATFORMS
    assert params.platforms("Web, Mobile Connected", default) == ["Web", "Mobile", "Connected"]
    assert params.platforms("", default) == ["Web", "Mobile", "Connected"]
    assert params.platforms(None, params.SCREEN_PLATFORMS) == ["Web", "Mobile"]


def test_sort_key():
    assert params.sort_key("videoStarts desc") == ("content_starts", "desc")
    assert params.sort_key("downloads ASC") == ("content_starts", "asc")
    assert params.sort_key("title") == ("episode_name", "asc")
    for bad in ("password desc", "title sideways"):
        with pytest.raises(ValueError):
            params.sort_key(bad)


def test_export_product():
    assert [params.export_product(p) for p in ("NowTV", "TVE", None)] == ["now tv", "TVE", None]
