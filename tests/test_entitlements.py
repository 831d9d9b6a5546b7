import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally.operators import nest
from playtally.plans import documents, entitlements
from playtally.sources.schemas import schema


@pytest.fixture(scope="module")
def t(spark):
    def frame(name, rows):
        return spark.createDataFrame(rows, schema(name))

    return {
        "users": frame("users", [
            (1, "Ann", "ann@acme.example", True, "x"), (2, "Bob", "bob@x.example", None, None),
            (3, None, None, False, None), (4, "Ann", "ann@acme.example", True, None),
        ]),
        "groups": frame("groups", [(10, "G10", "Live"), (11, "G2", "OnDemand"), (12, "G1", "Live")]),
        "brands": frame("brands", [
            (7, "A", "Live"), (8, "A", "Live"), (9, "B", "OnDemand"), (6, "A", "OnDemand"),
        ]),
        "roles": frame("roles", [(1, "admin", "Admin 10"), (2, "viewer", "Admin 9")]),
        "users_groups": frame("users_groups", [(1, 10), (1, 10), (1, 99), (2, 11), (3, 12)]),
        "users_brands": frame("users_brands", [(1, 7), (1, 9), (2, 55)]),
        "users_roles": frame("users_roles", [(1, 2), (1, 1)]),
        "groups_brands": frame("groups_brands", [(10, 7), (10, 8), (11, 77), (99, 9)]),
        "providers": frame("providers", [(1, "P1"), (2, "P2")]),
        "providers_brands": frame("providers_brands", [(1, 7), (1, 9), (2, 9), (2, 66)]),
        "brands_brands": frame("brands_brands", [(7, 9), (7, 8)]),
    }


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_access_keeps_links_to_missing_rows_as_nulls(t):
    access = entitlements.access_by_email(
        t["users"], t["users_groups"], t["groups"], t["groups_brands"], t["brands"],
        ["%acme%", "%bob@%"],
    )
    found = {(r.user_id, r.group_id, r.brand_id) for r in access.collect()}
    assert found == {
        (1, 10, 7), (1, 10, 8), (1, None, 9), (2, 11, None), (4, None, None)
    }


def test_brands_by_group_counts(spark, t):
    summary = spark.createDataFrame(
        [("A", "Live", dt.date(2022, 12, 1)), ("A", "Live", dt.date(2022, 11, 30)),
         ("A", "OnDemand", dt.date(2023, 1, 1))],
        "brand string, content_type string, event_date date",
    )
    rows = entitlements.brands_by_group(
        t["brands"], t["groups"], t["groups_brands"], t["users_groups"], t["users_brands"],
        summary, dt.date(2022, 12, 1),
    ).collect()
    seen = {
        (r.brand_id, r.group_id): (r.count_group_users, r.count_brand_users,
                                   r.count_events_last_90d)
        for r in rows
    }
    assert seen == {
        (7, 10): (2, 1, 1), (8, 10): (2, 0, 1), (9, None): (0, 1, 0), (6, None): (0, 0, 1)
    }


def test_system_comparison_adds_up_shared_emails(spark, t):
    old = spark.createDataFrame(
        [(100, "a", "ann@acme.example", True), (101, "b", "ann@acme.example", True),
         (102, "c", None, True)],
        schema("legacy_users"),
    )
    links = spark.createDataFrame([(100, 1), (101, 1), (101, 2), (102, 3)], "user_id bigint, x bigint")
    rows = {
        r.user_id: r
        for r in entitlements.system_comparison(
            t["users"], t["users_roles"], t["users_groups"], t["users_brands"],
            old, links, links, links.where("x = 2"),
        ).collect()
    }
    assert (rows[1].old_count_roles, rows[1].new_count_roles) == (3, 2)
    assert (rows[1].old_count_groups, rows[1].new_count_groups) == (3, 3)
    assert (rows[1].old_count_explicit_brands, rows[1].new_count_explicit_brands) == (1, 2)
    assert rows[4].old_count_roles == 3
    assert (rows[3].old_count_roles, rows[3].new_count_roles) == (0, 0)
    assert [rows[i].is_active for i in (1, 2, 3)] == ["Yes", "No", "No"]
    assert [rows[i].password_set for i in (1, 2)] == ["Yes", "No"]


def test_entitled_brands(t):
    args = [t[n] for n in ("users_brands", "users_groups", "groups_brands", "brands")]
    entitled = {(r.user_id, r.brand_id) for r in entitlements.entitled_brands(*args).collect()}
    assert entitled == {(1, 7), (1, 8), (1, 9)}
    live = entitlements.entitled_brands(*args, content_types=["Live"])
    assert {r.brand_id for r in live.collect()} == {7, 8}


def test_lookups(t):
    users, brands = t["users"], t["brands"]

    def ids(df):
        return sorted(r.user_id for r in df.collect())

    assert ids(entitlements.find_users(users, "AN")) == [1, 4]
    assert ids(entitlements.find_users(users)) == [1, 2, 4]
    assert ids(entitlements.find_users(users, "bob", "ann", mode="either")) == [1, 2, 4]
    assert ids(entitlements.find_users(users, "bob", "ann", mode="both")) == []
    assert ids(entitlements.user_by_email(users, "ANN@acme.EXAMPLE")) == [1]
    assert ids(entitlements.user_by_email(users, "ann@acme.example", is_active=False)) == []
    assert ids(entitlements.users_page(users, 2)) == [4]
    assert [r.name for r in entitlements.brand_names(brands, [9, 7, 8]).collect()] == ["A", "A", "B"]
    assert entitlements.brand_names(brands, []).count() == 0
    assert _rows(entitlements.canonical_brands(brands)) == {
        ("A", "Live", 7), ("B", "OnDemand", 9), ("A", "OnDemand", 6)
    }
    assert [r.label for r in entitlements.roles_in_order(t["roles"], "label").collect()] == [
        "Admin 9", "Admin 10"
    ]
    groups = entitlements.groups_of_user(t["users_groups"], t["groups"], 1)
    assert [r.group_id for r in groups.collect()] == [10]


def _user_documents(t, **options):
    return documents.user_documents(
        t["users"], t["users_groups"], t["groups"], t["users_brands"], t["brands"],
        t["users_roles"], t["roles"], **options,
    )


def test_user_documents(t):
    docs = {r.id: r.asDict(recursive=True) for r in _user_documents(t).collect()}
    assert set(docs) == {1, 2, 3, 4}
    assert docs[1]["role"] == {"id": 1, "name": "admin", "label": "Admin 10"}
    assert docs[4]["role"] == {"id": None, "name": None, "label": None}
    assert docs[1]["live_stream_brands"] == [{"id": 7, "name": "A", "content_type": "Live"}]
    assert docs[1]["vod_brands"] == [{"id": 9, "name": "B", "content_type": "OnDemand"}]
    assert [g["id"] for g in docs[1]["live_stream_groups"]] == [10]
    assert docs[2]["vod_brands"] == []
    assert docs[4]["vod_groups"] == []
    assert all((d["part"], d["parts"]) == (0, 1) for d in docs.values())
    [only] = _user_documents(t, user_id=2).collect()
    assert (only.id, [g.id for g in only.vod_groups]) == (2, [11])


def test_large_documents_continue_on_further_rows(spark, t):
    """A third of all links belong to one group; every one is in some part."""
    n = 900
    users = spark.range(n).select(
        F.col("id").alias("user_id"), F.concat(F.lit("U"), F.col("id")).alias("name"),
        F.lit("e").alias("email"), F.lit(True).alias("is_active"),
        F.lit(None).cast("string").alias("password"),
    )
    links = spark.range(n).select(
        F.col("id").alias("user_id"),
        F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") % 3 + 10).alias("group_id"),
    )
    copies = links.unionByName(links.where("group_id = 10"))
    docs = documents.group_documents(
        t["groups"], t["groups_brands"], t["brands"], copies, users, limit=50
    ).collect()
    by_group = {}
    for doc in docs:
        by_group.setdefault(doc.id, []).append(doc)
    for group_id, parts in by_group.items():
        members = [u.id for doc in parts for u in doc.users]
        expected = [r.user_id for r in links.where(F.col("group_id") == group_id).collect()]
        assert sorted(members) == sorted(expected)
        assert {doc.parts for doc in parts} == {len(parts)}
        assert sorted(doc.part for doc in parts) == list(range(len(parts)))
        assert len({doc.name for doc in parts}) == 1
    assert len(by_group[10]) > 1
    assert max(len(doc.users) for doc in docs) < 100
    brand_ids = [b.id for doc in by_group[10] for b in doc.brands]
    assert sorted(brand_ids) == [7, 8]
    for parts in by_group.values():
        inorder = [(u.name, u.id) for doc in sorted(parts, key=lambda d: d.part) for u in doc.users]
        assert inorder == sorted(inorder)


def test_heads_of_large_documents_are_one_row_each(spark):
    """Many rows of a head, and many parts, give one row a part; parts follow one another in order."""
    n = 400
    names = [f"N{i % 7}" if i % 5 else None for i in range(n)]
    links = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 3)], "owner long, id long")
    members = spark.createDataFrame(list(enumerate(names)), "id long, name string").select(
        "id", nest.child("id", "name", F.col("id").alias("id")).alias("children")
    )
    heads = {
        "title": spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "owner long, title string"),
        "flag": links.select("owner", F.lit(True).alias("flag")),
    }
    docs = nest.nest("owner", heads, [("id", links, members)], limit=10).collect()
    own = sorted((d for d in docs if d.owner == 1), key=lambda d: d.part)
    assert [d.part for d in own] == list(range(len(own))) and len(own) > 10
    assert {(d.title, d.flag, d.parts) for d in own} == {("A", True, len(own))}
    expected = sorted(range(n), key=lambda i: (names[i] is None, names[i] or "", i))
    assert [c.id for d in own for c in d.children] == expected
    rest = {d.owner: ([c.id for c in d.children], d.part, d.parts) for d in docs if d.owner != 1}
    assert rest == {2: ([3], 0, 1), 3: ([], 0, 1)}


def test_group_and_brand_documents(t):
    args = [t[n] for n in ("groups", "groups_brands", "brands", "users_groups", "users")]
    docs = {r.id: r for r in documents.group_documents(*args, content_type="live").collect()}
    assert set(docs) == {10, 12}
    assert [b.name for b in docs[10].brands] == ["A(7)", "A(8)"]
    assert [(u.id, u.active) for u in docs[10].users] == [(1, True)]
    # A member without a name still belongs.
    assert [(u.id, u.name) for u in docs[12].users] == [(3, None)]
    [one] = documents.group_documents(*args, group_id=11).collect()
    assert (one.id, one.brands, [u.id for u in one.users]) == (11, [], [2])
    brands = {
        r.id: r for r in documents.brand_documents(
            t["brands"], t["brands_brands"], t["users_brands"], t["users"]
        ).collect()
    }
    assert [b.id for b in brands[7].brands] == [8, 9]
    assert [u.id for u in brands[7].users] == [1]
    assert brands[6].users == []


def test_user_records(spark, t):
    second = spark.createDataFrame([(9,)], "brand_id bigint")
    records = documents.user_records(
        t["users"], t["users_groups"], t["groups"], t["users_brands"], t["brands"],
        t["users_roles"], t["roles"], t["providers"], t["providers_brands"], second,
    )
    by_id = {r.id: r for r in records.collect()}
    ann, nobody = by_id[1], by_id[3]
    assert ann.rolesConcat == "admin,viewer"
    assert (ann.vodBrandsConcat, ann.liveStreamBrandsConcat) == ("9|9", "7")
    assert [b.id for b in ann.brands] == [7, 9]
    assert [p.id for p in ann.vodProviders] == [1, 2]
    assert [p.id for p in ann.liveStreamProviders] == [1]
    assert (ann.nowtv, ann.productOptions) == (True, ["TVE", "NOWTV"])
    assert (nobody.name, nobody.email, nobody.isActive) == ("", "", False)
    assert (nobody.nowtv, nobody.productOptions, nobody.providers) == (False, ["TVE"], [])
    short = documents.short_user_records(records)
    assert short.columns[:2] == ["name", "roles"]
    assert '"id":9' in nest.as_json(short).where("name = 'Ann' and nowtv").first().brands


def test_option_lists(t):
    brands = documents.brand_options(t["brands"], "LIVE").collect()
    assert [(r.label, r.value) for r in brands] == [("A", 7)]
    groups = documents.group_options(t["groups"], "live").collect()
    assert [r.label for r in groups] == ["G1", "G10"]
    labels = {r.value: r.label for r in documents.user_options(t["users"]).collect()}
    assert labels[1] == "Ann (ann@acme.example)"
    assert labels[3] == " ()"
    with pytest.raises(ValueError):
        documents.brand_options(t["brands"], "all")
