"""Flat children, natural ranks, list-driven syncs and request days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from playtally import functions as fn
from playtally import params
from playtally.operators import membership, nest, numbering
from playtally.plans import documents
from playtally.sources import star_schema
from playtally.sources.schemas import schema

FOLDER = "/root/testdata/sf0.001"


def test_flat_children_are_the_arrays_of_documents(spark):
    names = ("users", "users_groups", "groups", "users_brands", "brands", "users_roles", "roles")
    tables = [getattr(star_schema, name)(spark, FOLDER) for name in names]
    flat = {}
    for r in documents.user_children(*tables[:5]).collect():
        flat.setdefault((r.user_id, r.kind), []).append((r.position, r.id, r.name, r.content_type))
    count = 0
    for document in documents.user_documents(*tables).collect():
        for kind in ("vod_brands", "vod_groups", "live_stream_brands", "live_stream_groups"):
            nested = [(i, *child) for i, child in enumerate(document[kind])]
            assert sorted(flat.pop((document.id, kind), [])) == nested
            count += len(nested)
    assert not flat and count > 500


def test_a_hot_parent_is_cut_by_halving_and_numbered_whole(spark):
    # Half of all links are those of one parent; names tie, and some are null.
    links = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("member")
    )
    name = F.when(F.col("id") % 97 != 0, F.concat(F.lit("n"), (F.col("id") % 400).cast("string")))
    item = nest.child("member", name, F.col("member").alias("id"))
    members = spark.range(20000).withColumn("member", F.col("id")).select("member", item.alias("items"))
    heads = {"head": links.select("key", F.lit(1).alias("head")).distinct()}
    children = [("member", links, members)]
    rows = nest.nest("key", heads, children, limit=500).where("key = 1").orderBy("part").collect()
    assert len(rows) == rows[0].parts > 10 and max(len(r["items"]) for r in rows) < 2000
    flat = nest.flat_children("key", children).where("key = 1").orderBy("position").collect()
    assert [r.position for r in flat] == list(range(len(flat)))
    assert [r.id for r in flat] == [x.id for r in rows for x in r["items"]]


@pytest.mark.parametrize("size", [0, 1, 2, 7, 8])
def test_ends_up_to_a_value(spark, size):
    ends = sorted(random.Random(size).choices(range(10), k=size))
    df = spark.range(-1, 12).select("id", F.lit(ends).cast("array<bigint>").alias("ends"))
    found = df.select("id", nest._ends_up_to(F.col("ends"), F.col("id")).alias("n")).collect()
    assert {r.id: r.n for r in found} == {v: sum(e <= v for e in ends) for v in range(-1, 12)}


def test_natural_order(spark):
    ordered = [
        "#1", "0", "000 1", "2", "10", "9" * 40, "1" + "0" * 40, "a", "A#", "a 1", "A1#", "a1b", "a02", "A 10",
        "AB", "brand 9", "Brand\t10", "BRAND 10 b 2", "brand10B10", "é1",
    ]
    shuffled = random.Random(1).sample(ordered, len(ordered))
    df = spark.createDataFrame([(n,) for n in [*shuffled, None, "A01", "a 2"]], "name string").repartition(3)
    ranks = {r.name: r.rank for r in numbering.ranked(df, fn.natural_order(F.col("name"))).collect()}
    assert ranks.pop(None) == len(ordered) + 1
    assert (ranks.pop("A01"), ranks.pop("a 2")) == (ranks["a 1"], ranks["a02"])
    assert sorted(ranks, key=ranks.get) == ordered
    assert sorted(ranks.values()) == list(range(1, len(ordered) + 1))


def test_lists_edit_only_their_content_types(spark):
    brands = spark.createDataFrame(
        [(1, "A", "Live"), (2, "A", "Live"), (3, "B", "OnDemand"), (4, "C", "Radio"), (5, "D", "Live"), (6, "A", "OnDemand")],
        schema("brands"),
    )
    current = spark.createDataFrame(
        [(u, b) for u in (1, 2, 3, 4) for b in (1, 2, 3, 4)] + [(1, 99)], schema("users_brands")
    )
    requests = spark.createDataFrame(
        [(1, "6|6, 4, 77,x", ""), (2, None, "5|5,1"), (3, "", None), (5, "3,3", "2"), (5, None, "5")],
        "user_id bigint, vod string, live string",
    )
    found = membership.sync_from_lists(
        current, requests, {"vod": "OnDemand", "live": "Live"}, "user_id", "brand_id", brands
    )
    by = {}
    for r in found.collect():
        by.setdefault(r.user_id, set()).add(r.brand_id)
    assert by == {
        # Brand 4 is no on-demand brand, 99 no brand at all: both links stay as they are.
        1: {4, 6, 99},
        # Brand 2 goes, and so does its copy 1, although it is listed.
        2: {3, 4, 5},
        3: {1, 2, 4},
        4: {1, 2, 3, 4},
        5: {2, 3, 5},
    }


def test_second_product_brands_are_viewed_by_name_and_type(spark):
    brands = spark.createDataFrame(
        [(1, "A", "Live"), (2, "A", "Live"), (3, "A", "OnDemand"), (4, "B", "Live")], schema("brands")
    )
    viewing = spark.createDataFrame(
        [("A", "Live", "IntroTV"), ("A", "OnDemand", "other"), ("B", "Live", None)],
        "brand string, content_type string, x1_user_type string",
    )
    found = documents.second_product_brands(viewing, brands).collect()
    assert sorted(r.brand_id for r in found) == [1, 2]


def test_request_days_are_those_of_parameters(spark):
    forms = ["", "T00:00:00", "T00:00:00+09:00", "T23:59:59-05:00", "T23:59:59", "T02:30:00+03:00", "T22:15:00-05:00",
             "T22:15:00-0530", "T12:00", "T00:00:00Z"]
    texts = [f"2024-03-0{1 + i % 3}{form}" for i, form in enumerate(forms)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fn.first_request_day(df.t).alias("a"), fn.last_request_day(df.t).alias("b")).collect():
        assert (r.a, r.b) == params.days_from_text(r.t, r.t)
    df = spark.createDataFrame([("0",), ("-1",), ("1700000000123",), ("x",), (None,)], "t string")
    days = [r[0] for r in df.select(fn.day_of_epoch_ms(df.t)).collect()]
    assert days == [dt.date(1970, 1, 1), dt.date(1969, 12, 31), dt.date(2023, 11, 14), None, None]
