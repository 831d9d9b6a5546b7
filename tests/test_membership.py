import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtally import functions as fn
from playtally.operators import corrections, membership, numbering, upserts
from playtally.sources import tables
from playtally.sources.schemas import schema


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame(
        [(7, "A", "Live"), (8, "A", "Live"), (9, "B", "Live"), (5, "A", "OnDemand")],
        schema("brands"),
    )


def _links(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id bigint, brand_id bigint")


def _pairs(df):
    return sorted((r.user_id, r.brand_id) for r in df.collect())


def _actions(df):
    return sorted((r.action, r.user_id, r.brand_id) for r in df.collect())


def _sync(current, desired, **options):
    changes = membership.membership_changes(
        current, desired, "user_id", "brand_id", **options
    )
    return membership.apply_changes(current, changes, "user_id", "brand_id")


def test_diff_ignores_copies(spark):
    current = _links(spark, (1, 7), (1, 7), (1, 8), (2, 7))
    desired = _links(spark, (1, 8), (1, 8), (1, 9), (1, 9))
    diff = membership.membership_diff(current, desired, "user_id", "brand_id")
    assert _actions(diff) == [("delete", 1, 7), ("delete", 2, 7), ("insert", 1, 9)]


def test_owners_out_of_scope_keep_their_links(spark):
    current, desired = _links(spark, (1, 7), (2, 7)), _links(spark, (1, 8), (3, 9))
    scope = spark.createDataFrame([(1,), (1,)], "user_id bigint")
    assert _pairs(_sync(current, desired, scope=scope)) == [(1, 8), (2, 7)]


def test_deletes_reach_copies_even_if_desired(spark, brands):
    current = _links(spark, (1, 7), (1, 8), (1, 5), (2, 7), (2, 8))
    desired = _links(spark, (1, 7), (1, 5), (2, 7), (2, 8))
    # 8 goes, and with it its copy 7; the other content type stays.
    assert _pairs(_sync(current, desired, dimension=brands)) == [(1, 5), (2, 7), (2, 8)]
    assert _pairs(_sync(current, desired)) == [(1, 5), (1, 7), (2, 7), (2, 8)]


def test_new_link_to_a_copy_of_a_removed_member_is_not_kept(spark, brands):
    current, desired = _links(spark, (1, 7)), _links(spark, (1, 8))
    assert _pairs(_sync(current, desired, dimension=brands)) == []
    changes = membership.membership_changes(
        current, desired, "user_id", "brand_id", brands
    )
    assert _actions(changes) == [("delete", 1, 7)]


def test_removed_member_without_dimension_row_goes(spark, brands):
    current = _links(spark, (1, 99), (1, 9))
    assert _pairs(_sync(current, _links(spark, (1, 9)), dimension=brands)) == [(1, 9)]


def test_sync_is_idempotent(spark, brands):
    current = _links(spark, (1, 7), (1, 9), (2, 5))
    desired = _links(spark, (1, 9), (2, 5), (2, 9))
    once = _sync(current, desired, dimension=brands)
    changes = membership.membership_changes(once, desired, "user_id", "brand_id", brands)
    assert changes.count() == 0
    assert _pairs(once) == [(1, 9), (2, 5), (2, 9)]


def test_group_side_duplicates(spark):
    """Removing a user from a group removes it from the group's copies."""
    groups = spark.createDataFrame(
        [(1, "G", "Live"), (2, "G", "Live"), (3, "H", "Live")], schema("groups")
    )
    columns = "group_id bigint, user_id bigint"
    current = spark.createDataFrame([(1, 50), (2, 50), (3, 50), (2, 51)], columns)
    desired = spark.createDataFrame([(2, 50), (3, 50), (2, 51)], columns)
    changes = membership.membership_changes(
        current, desired, "group_id", "user_id", groups, duplicates_of="group_id"
    )
    left = membership.apply_changes(current, changes, "group_id", "user_id")
    assert sorted(tuple(r) for r in left.collect()) == [(2, 51), (3, 50)]


def test_lists_to_desired_links(spark):
    rows = spark.createDataFrame(
        [(1, "8919|8919,7", "9"), (2, None, "9,9")], "user_id bigint, vod string, live string"
    )
    ids = membership.requested_ids(fn.id_list(F.col("vod")), fn.id_list(F.col("live")))
    desired = membership.desired_links(
        rows.select("user_id", ids.alias("ids")), "user_id", "ids", "brand_id"
    )
    assert _pairs(desired) == [(1, 7), (1, 9), (1, 8919), (2, 0), (2, 9)]


def test_clear_one_content_type(spark, brands):
    current = _links(spark, (1, 7), (1, 5), (2, 7))
    owners = spark.createDataFrame([(1,)], "user_id bigint")
    cleared = membership.clear_content_type(
        current, owners, brands, "user_id", "brand_id", "Live"
    )
    assert _pairs(cleared) == [(1, 5), (2, 7)]


def test_single_valued_upsert(spark):
    roles = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], schema("users_roles"))
    changes = spark.createDataFrame([(1, 3), (5, 4), (5, 4)], schema("users_roles"))
    new = membership.upsert_single(roles, changes, "user_id")
    assert sorted(tuple(r) for r in new.collect()) == [(1, 3), (2, 1), (5, 4)]


# --- corrections -----------------------------------------------------------

DAY = dt.date(2023, 5, 26)


def _corrections():
    brands = ["A", "B"]
    return [
        corrections.Correction("x1_user_type", "introtv", DAY, DAY, brands, F.col("pct100_viewed") == 0),
        corrections.Correction("x1_user_type", "", DAY, DAY, brands, F.col("pct100_viewed") > 0),
    ]


def _summary(spark, rows):
    return spark.createDataFrame(
        rows, "event_date date, brand string, pct100_viewed bigint, x1_user_type string"
    )


def test_corrections(spark):
    other_day = dt.date(2023, 5, 27)
    summary = _summary(spark, [
        (DAY, "A", 0, "x"), (DAY, "A", 3, "x"), (DAY, "A", None, "x"), (DAY, "C", 0, "x"),
        (other_day, "A", 0, "x"), (DAY, None, 0, None),
    ])
    types = [r.x1_user_type for r in corrections.correct(summary, _corrections()).collect()]
    assert types == ["introtv", "", "x", "x", "x", None]


def test_correcting_a_table_rewrites_only_its_days(spark, tmp_path):
    path, staging = str(tmp_path / "summary"), str(tmp_path / "staging")
    days = [DAY + dt.timedelta(days=i) for i in range(-1, 2)]
    rows = [(day, brand, i % 2, "x") for day in days for i, brand in enumerate("ABC")]
    tables.write_table(_summary(spark, rows), path, "event_date")
    files = {p.name for p in (tmp_path / "summary").glob("event_date=*/*.parquet")}
    corrections.correct_table(spark, path, staging, _corrections())
    table = spark.read.parquet(path)
    assert table.count() == 9
    changed = table.where("x1_user_type <> 'x'").collect()
    assert {(r.event_date, r.brand, r.x1_user_type) for r in changed} == {
        (DAY, "A", "introtv"), (DAY, "B", "")
    }
    kept = {
        p.name for day in (days[0], days[2])
        for p in (tmp_path / "summary" / f"event_date={day}").glob("*.parquet")
    }
    assert kept <= files


def _rows_of_day(spark, path):
    return sorted((r.event_date, r.brand, r.pct100_viewed, r.x1_user_type) for r in spark.read.parquet(path).collect())


def _chain():
    """Applied twice, it would move a row on from p1 to p2."""
    brands = ["A", "B", "C"]
    days = DAY, DAY + dt.timedelta(days=2)
    return [
        corrections.Correction("x1_user_type", "p2", *days, brands, F.col("x1_user_type") == "p1"),
        corrections.Correction("x1_user_type", "p1", *days, brands, F.col("x1_user_type") == "p0"),
    ]


@pytest.fixture
def chain_table(spark, tmp_path):
    path, staging = str(tmp_path / "summary"), str(tmp_path / "staging")
    rows = [(DAY + dt.timedelta(days=i), b, i, f"p{j}") for i in range(3) for j, b in enumerate("ABC")]
    tables.write_table(_summary(spark, rows), path, "event_date")
    expected = sorted((*r[:3], {"p0": "p1", "p1": "p2", "p2": "p2"}[r[3]]) for r in rows)
    return path, staging, expected


def test_a_repeated_correction_changes_nothing(spark, chain_table):
    path, staging, expected = chain_table
    for _ in range(3):
        corrections.correct_table(spark, path, staging, _chain())
        assert _rows_of_day(spark, path) == expected
    # Rows that came since are corrected, the others are not corrected again.
    new = (DAY, "A", 9, "p0")
    _summary(spark, [new]).write.mode("append").partitionBy("event_date").parquet(path)
    for _ in range(2):
        corrections.correct_table(spark, path, staging, _chain())
        assert _rows_of_day(spark, path) == sorted([*expected, (*new[:3], "p1")])


@pytest.mark.parametrize("stop", range(5))
def test_a_stopped_correction_is_carried_through(spark, chain_table, monkeypatch, stop):
    path, staging, expected = chain_table
    steps = iter(range(100))

    def breaking(method):
        def run(self, *args):
            if next(steps) == stop:
                raise KeyboardInterrupt
            return method(self, *args)

        return run

    with monkeypatch.context() as patch:
        for name in ("_swap", "_write"):
            patch.setattr(corrections._Files, name, breaking(getattr(corrections._Files, name)))
        with pytest.raises(KeyboardInterrupt):
            corrections.correct_table(spark, path, staging, _chain())
    corrections.correct_table(spark, path, staging, _chain())
    assert _rows_of_day(spark, path) == expected


def test_a_second_set_of_corrections_keeps_rows_that_came_between(spark, chain_table):
    path, staging, expected = chain_table
    corrections.correct_table(spark, path, staging, _chain())
    new = (DAY, "B", 7, "x")
    _summary(spark, [new]).write.mode("append").partitionBy("event_date").parquet(path)
    other_day = DAY + dt.timedelta(days=1)
    second = corrections.Correction("x1_user_type", "q", other_day, other_day, ["A"])
    corrections.correct_table(spark, path, staging, [second])
    changed = [(*r[:3], "q") if r[:2] == (other_day, "A") else r for r in expected]
    assert _rows_of_day(spark, path) == sorted([*changed, new])


# --- upserts ---------------------------------------------------------------


def _log(spark, rows):
    return spark.createDataFrame(rows, "seq int, group_id bigint, name string, content_type string")


def _upsert(spark, groups, log):
    table, rejects = upserts.upsert_rows(
        spark.createDataFrame(groups, schema("groups")), _log(spark, log),
        "group_id", ["name", "content_type"], "name", "seq",
    )
    rejected = sorted((r.seq, r.reason) for r in rejects.collect())
    return sorted(tuple(r) for r in table.collect()), rejected


def test_upsert_rows(spark):
    table, rejects = _upsert(
        spark,
        [(1, "One", "Live"), (2, "Two", "Live")],
        [(1, 1, "Uno", None), (2, 9, "Nine", "Live"), (3, None, " New ", "Live"), (4, 0, "New", "Live"),
         (5, -3, "Two", "Live"), (6, None, "  ", "Live"), (7, None, None, "Live"), (8, None, "Two", "OnDemand")],
    )
    assert table == [(1, "Uno", "Live"), (2, "Two", "Live"), (3, "New", "Live"), (4, "Two", "OnDemand")]
    assert rejects == [(2, "not found"), (6, "name is required"), (7, "name is required")]


def test_the_last_whole_change_counts(spark):
    # Column by column, the greatest values would be "Z" and "OnDemand" of different changes.
    table, _ = _upsert(
        spark, [(1, "One", "Live")],
        [(2, 1, "Z", "Live"), (3, 1, "B", "Live"), (1, 1, "A", "OnDemand"), (4, 1, None, "Mixed")],
    )
    assert table == [(1, "One", "Mixed")]


def test_creations_meet_the_updated_table(spark):
    # The name given up is free again, the new one is taken; null is a value of the natural key.
    table, _ = _upsert(
        spark,
        [(4, "One", "Live"), (7, "Two", None)],
        [(1, None, "One", "Live"), (2, None, "Uno", "Live"), (3, 4, "Uno", None), (4, None, "Two", None)],
    )
    assert table == [(4, "Uno", "Live"), (7, "Two", None), (8, "One", "Live")]


def test_created_ids_have_no_gaps_and_two_kinds_of_stamps(spark):
    users = spark.createDataFrame(
        [(5, "A", "a@x", None, 1), (6, "B", "b@x", 2, 1)],
        "user_id bigint, name string, email string, modified_by bigint, created_by bigint",
    )
    changes = spark.range(5000).repartition(7).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") == 0, 5).otherwise(None).cast("long").alias("user_id"),
        F.concat(F.lit("N"), F.col("id")).alias("name"),
        F.when(F.col("id") > 0, F.concat(F.lit("u"), F.lpad((F.col("id") % 4000).cast("string"), 4, "0"))).alias("email"),
    )
    made = [
        upserts.upsert_rows(
            users, changes, "user_id", ["email"], "email", "seq",
            {"created_by": F.lit(42).cast("long")}, {"modified_by": F.lit(43).cast("long")},
        )
        for _ in range(2)
    ]
    rows = [sorted(tuple(r) for r in table.collect()) for table, _ in made]
    assert rows[0] == rows[1] and made[0][1].count() == 0
    assert rows[0][:2] == [(5, "N0", "a@x", 43, 1), (6, "B", "b@x", 2, 1)]
    created = rows[0][2:]
    assert [r[0] for r in created] == list(range(7, 7 + 4000))
    assert [r[2] for r in created] == [f"u{i:04}" for i in range(4000)]
    # Of equal creations the last one counts.
    assert created[1] == (8, "N4001", "u0001", None, 42) and created[1000][1] == "N1000"


# --- numbering -------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 13])
def test_numbers_follow_the_order_without_gaps(spark, partitions):
    # A third of the rows share one key, and some rows are equal.
    df = spark.range(3000).repartition(partitions).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900).alias("k"),
        (F.col("id") % 1000).alias("v"),
    )
    rows = numbering.numbered(df, [("k", "desc"), ("v", "asc")], "n", 10).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(10, 3010))
    order = [(r.k is not None, -(r.k or 0), r.v) for r in rows]
    assert order == sorted(order)
    within = numbering.numbered_within(df, ["k"], [("v", "desc")], first=1).collect()
    by = {}
    for r in within:
        by.setdefault(r.k, []).append((r.position, r.v))
    for own in by.values():
        assert [p for p, _ in sorted(own)] == list(range(1, len(own) + 1))
        assert [v for _, v in sorted(own)] == sorted((v for _, v in own), reverse=True)
    assert numbering.numbered(df.where("false"), [("k", "asc")]).collect() == []
