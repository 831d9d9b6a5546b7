"""Every registered query against its DuckDB twin."""

import pytest

import __spark_entry__
from checks.catalogue import QUERIES
from checks.compare import compare, connect
from checks.oracle import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"

# Queries whose joins are worth running without any broadcast.
SHUFFLED = [
    "vod_performance_export",
    "merged_events_all",
    "access_by_domain",
    "system_comparison",
    "entitled_brands",
    "user_records",
    "membership_sync",
    "group_upsert",
]


@pytest.fixture(scope="module")
def twin():
    with connect(FOLDER) as connection:
        yield connection


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_equal(spark, twin, name):
    assert compare(spark, twin, FOLDER, name) is None


@pytest.mark.parametrize("name", SHUFFLED)
def test_equal_without_broadcast(spark, twin, no_broadcast, name):
    assert compare(spark, twin, FOLDER, name) is None


def test_results_are_not_empty(twin):
    empty = {
        name
        for name, sql in ORACLE_SQL.items()
        if twin.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0
    }
    # At the smallest scale there is no second page.
    assert empty <= {"vod_performance_page"}


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:3] == ["product", "platform", "brand"]
