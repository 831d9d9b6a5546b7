"""Rows that users and the brands of their groups fan out to are not shuffled or compared."""

import pytest

from playtally.plans import entitlements
from playtally.sources.schemas import schema
from tests.conftest import final_plan_of


def _shuffled_rows(df):
    """Most rows that one shuffle of the executed plan wrote."""
    final_plan_of(df)

    def sizes(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from sizes(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from sizes(plan.plan())
        elif name == "ShuffleExchangeExec":
            yield plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        for i in range(children.size()):
            yield from sizes(children.apply(i))

    return max(sizes(df._jdf.queryExecution().executedPlan()))


@pytest.fixture(scope="module")
def many(spark):
    """400 users in two of four groups that open 100 of 250 brands each."""
    def frame(name, rows):
        return spark.createDataFrame(rows, schema(name))

    return {
        "users_groups": frame("users_groups", [(u, (u + k) % 4) for u in range(400) for k in (0, 1)]),
        "groups_brands": frame("groups_brands", [(g, 50 * g + b) for g in range(4) for b in range(100)]),
        "brands": frame("brands", [(b, f"B{b % 40}", "OnDemand") for b in range(250)]),
        "users_brands": frame("users_brands", [(u, (7 * u) % 300) for u in range(0, 800, 2)]),
    }


def test_entitled_brands_are_not_shuffled(many):
    entitled = entitlements.entitled_brands(
        many["users_brands"], many["users_groups"], many["groups_brands"], many["brands"], ["OnDemand"]
    )
    by_group = {(u, 50 * ((u + k) % 4) + b) for u in range(400) for k in (0, 1) for b in range(100)}
    explicit = {(u, (7 * u) % 300) for u in range(0, 800, 2) if (7 * u) % 300 < 250}
    found = [(r.user_id, r.brand_id) for r in entitled.collect()]
    assert sorted(found) == sorted(by_group | explicit)
    assert _shuffled_rows(entitled) < len(found) / 10


def test_entitled_brands_of_repeated_null_and_unknown_keys(spark):
    """Copies of any row, null keys, a user without id, brands of one id and several names."""
    def frame(name, rows):
        return spark.createDataFrame(rows, schema(name))

    users_brands = [(1, 7), (1, 7), (None, 7), (None, 9), (None, None), (2, 55), (3, 9), (5, 8), (5, None)]
    users_groups = [
        (1, 10), (1, 10), (1, 11), (2, 11), (2, 10), (None, 10), (None, None), (3, None), (4, 12), (6, 99), (7, 12),
        (7, 10),
    ]
    groups_brands = [(10, 7), (10, 7), (10, 8), (11, 7), (11, 9), (12, None), (None, 9), (12, 77), (99, 9)]
    brands = [
        (7, "A", "Live"), (7, "A", "Live"), (7, "B", "Live"), (8, None, "Live"), (9, "C", "OnDemand"),
        (9, "C", None), (None, "D", "Live"),
    ]
    links = set(users_brands) | {(u, b) for u, g in users_groups for h, b in groups_brands if g == h and g is not None}
    entitled = {(u, *row) for u, b in links for row in brands if b is not None and row[0] == b}
    args = [
        frame("users_brands", users_brands), frame("users_groups", users_groups),
        frame("groups_brands", groups_brands), frame("brands", brands),
    ]

    def rows(**options):
        return sorted((tuple(r) for r in entitlements.entitled_brands(*args, **options).collect()), key=repr)

    assert rows() == sorted(entitled, key=repr)
    assert rows(content_types=["Live"]) == sorted((r for r in entitled if r[3] == "Live"), key=repr)
    assert rows(user_id=1) == sorted((r for r in entitled if r[0] == 1), key=repr)
    assert rows(content_types=[]) == []


ACCESS = [
    "user_id", "user_email", "user_name", "user_active", "group_id", "group_name", "group_content_type",
    "brand_id", "brand_name", "brand_content_type",
]


def _access(users, users_groups, groups, groups_brands, brands, part):
    """Distinct rows of access in their order, by loops over the links; nulls come last."""
    rows = set()
    for user_id, name, email, is_active, _ in users:
        if email is None or part not in email:
            continue
        links = {g for u, g in users_groups if u is not None and u == user_id} or {None}
        for link in links:
            named = {g for g in groups if link is not None and g[0] == link} or {(None, None, None)}
            opened = {b for g, b in groups_brands if link is not None and g == link} or {None}
            for b in opened:
                shown = {x for x in brands if b is not None and x[0] == b} or {(None, None, None)}
                rows |= {(user_id, email, name, is_active, *g, *x) for g in named for x in shown}
    order = [ACCESS.index(c) for c in ("user_name", "brand_name", "brand_content_type")]
    order += [i for i in range(len(ACCESS)) if i not in order]
    return sorted(rows, key=lambda row: [(row[i] is None, 0 if row[i] is None else row[i]) for i in order])


def test_access_rows_of_a_group_are_not_shuffled_one_by_one(spark, many):
    users = [(u, f"U{u % 90}", f"u{u}@acme", u % 3 == 0, None) for u in range(410)]
    groups = [(g, f"G{g}", "Live") for g in range(4)]
    access = entitlements.access_by_email(
        spark.createDataFrame(users, schema("users")), many["users_groups"],
        spark.createDataFrame(groups, schema("groups")), many["groups_brands"], many["brands"], ["%ACME%"],
    )
    links = [[tuple(r) for r in many[n].collect()] for n in ("users_groups", "groups_brands", "brands")]
    found = [tuple(r) for r in access.collect()]
    assert access.columns == ACCESS
    assert found == _access(users, links[0], groups, *links[1:], "acme")
    assert _shuffled_rows(access) < len(found) / 2


def test_access_of_repeated_null_and_unknown_keys(spark, monkeypatch):
    """Copies of any row, null keys and names, missing groups that open the same brands, long lists."""
    monkeypatch.setattr(entitlements, "LIST_SIZE", 2, raising=False)
    users = [
        (1, "Ann", "a@x", True, None), (1, "Ann", "a@x", True, "p"), (1, "Bea", "a@x", None, None),
        (2, None, "b@x", False, None), (None, "Cy", "c@x", True, None), (None, "Cy", "c@x", True, None),
        (3, "Ann", "d@x", True, None), (4, "Dan", None, True, None), (5, "Eve", "e@x", True, None),
        (6, "Fay", "f@x", True, None), (7, None, "g@x", None, None),
    ]
    users_groups = [
        (1, 10), (1, 10), (1, 11), (2, 98), (2, 99), (2, 10), (3, 10), (3, 97), (None, 10), (4, 10), (5, None),
        (6, 12), (6, 96), (6, 95), (7, 11), (7, 10),
    ]
    groups = [
        (10, "G", "Live"), (10, "G", "Live"), (10, "H", None), (11, None, "OnDemand"), (12, "I", "Live"),
        (None, "N", "Live"),
    ]
    groups_brands = [
        *[(10, b) for b in (1, 2, 3, 4, 5, 6, 7, 8, 8, 70, 71, None)], (11, 2), (11, 3), (98, 1), (98, 3), (98, 72),
        (99, 3), (99, 3), (99, 1), (99, 73), (97, 5), (None, 4),
    ]
    brands = [
        *[(b, "A", "Live") for b in (1, 2, 3, 4, 5)], (5, "A", "Live"), (5, "B", "Live"), (6, None, None),
        (7, None, "Live"), (8, "A", None), (None, "N", "Live"),
    ]
    names = ("users", "users_groups", "groups", "groups_brands", "brands")
    given = [users, users_groups, groups, groups_brands, brands]
    frames = [spark.createDataFrame(rows, schema(name)) for name, rows in zip(names, given, strict=True)]
    expected = _access(*given, "@x")
    found = [tuple(r) for r in entitlements.access_by_email(*frames, ["%@x%"]).collect()]
    assert found == expected
    unsorted = [tuple(r) for r in entitlements.access_by_email(*frames, ["%@x%"], sort=False).collect()]
    assert sorted(unsorted, key=repr) == sorted(expected, key=repr)
