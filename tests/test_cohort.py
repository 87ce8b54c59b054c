import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import cohort, labels, window


def ids(df, column="entity_id"):
    return sorted(r[column] for r in df.collect())


STAYS = "entity_id bigint, stay_id bigint, admit ts, disch ts, deathtime ts, note string"


@pytest.fixture
def stays(frame):
    return frame(
        [
            (1, 11, "2020-01-01 00:00:00", "2020-01-05 00:00:00", None, None),
            (1, 12, "2020-02-01 00:00:00", "2020-02-05 00:00:00", "2020-02-03 00:00:00", "later"),
            (2, 22, "2020-01-01 00:00:00", "2020-01-05 00:00:00", None, "b"),
            (2, 21, "2020-01-01 00:00:00", "2020-01-09 00:00:00", None, "a"),
            (3, 31, None, "2020-01-09 00:00:00", None, "no start"),
            (3, 32, "2021-01-01 00:00:00", "2021-01-09 00:00:00", None, "start"),
        ],
        STAYS,
    )


def test_index_stay_first_row(stays):
    got = {r["entity_id"]: r for r in cohort.index_stay(stays).collect()}
    assert got[1]["stay_id"] == 11 and got[1]["deathtime"] is None and got[1]["note"] is None
    assert got[2]["stay_id"] == 21  # same start: the smaller id
    assert got[3]["stay_id"] == 32  # a missing start comes last


def test_index_stay_first_non_null(stays):
    got = {r["entity_id"]: r for r in cohort.index_stay(stays, mode="first_non_null").collect()}
    assert got[1]["stay_id"] == 11 and got[1]["note"] == "later"
    assert got[1]["deathtime"] is not None  # taken from the second stay


def test_index_stay_ignores_row_order(stays):
    again = cohort.index_stay(stays.repartition(3, "note").orderBy(F.desc("stay_id")))
    key = lambda r: r["entity_id"]
    assert sorted(again.collect(), key=key) == sorted(cohort.index_stay(stays).collect(), key=key)


def horizon_frame(frame):
    base = "2020-01-01 00:00:00"
    ends = [
        "2020-01-03 05:54:00", "2020-01-03 06:00:00", "2020-01-03 06:06:00",
        "2020-01-08 00:00:00", "2020-01-08 00:06:00",
    ]
    rows = [(i, i * 10, base, e, None, None) for i, e in enumerate(ends, 1)]
    return frame(rows, STAYS)


def test_horizon_edges(frame):
    stays = cohort.with_los(horizon_frame(frame))
    kept = cohort.min_stay(stays)
    assert ids(kept) == [2, 3, 4, 5]
    people = frame([(i, None) for i in range(1, 6)], "entity_id bigint, dod ts")
    table = labels.label_table(kept, stays, people)
    assert ids(table) == [3, 4, 5]  # a stay of exactly 54 h passes the filter but counts as early
    long_stay = {r["entity_id"]: r["prolonged_los_label"] for r in table.collect()}
    assert long_stay == {3: 0, 4: 0, 5: 1}
    offsets = cohort.early_event_offsets(kept, stays, people)
    assert ids(cohort.exclude_early(kept, offsets)) == [3, 4, 5]


def test_death_label_edges(frame):
    disch = "2020-01-10 12:00:00"
    dods = [
        "2020-01-10 11:59:00", "2020-01-10 12:00:00", "2020-02-09 12:00:00",
        "2020-02-09 12:01:00", "2019-12-31 00:00:00", "2020-01-10 00:00:00", None,
    ]
    index = frame(
        [(i, i, "2020-01-01 00:00:00", disch, None) for i in range(1, 8)],
        "entity_id bigint, stay_id bigint, admit ts, disch ts, deathtime ts",
    )
    people = frame(list(enumerate(dods, 1)), "entity_id bigint, dod ts")
    got = {r[0]: r[2] for r in labels.label_death(index, people).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    by_date = {
        r[0]: r[2] for r in labels.label_death(index, people, date_granularity=True).collect()
    }
    assert by_date[6] == 1 and by_date[1] == 1 and by_date[4] == 1
    died = index.withColumn("deathtime", F.col("disch"))
    assert all(r[2] == 1 for r in labels.label_death(died, people).collect())
    assert all(r[2] == 1 for r in labels.label_death(index, people, stays=died).collect())


def test_readmission_edges(frame):
    starts = [
        "2020-01-10 12:00:00", "2020-01-10 12:01:00", "2020-02-09 12:00:00",
        "2020-02-10 12:00:00", None,
    ]
    first = [
        (i, i, "2020-01-01 00:00:00", "2020-01-10 12:00:00", None, None) for i in range(1, 6)
    ]
    later = [
        (i, 100 + i, s, "2020-03-01 00:00:00", None, None) for i, s in enumerate(starts, 1) if s
    ]
    stays = frame(first + later, STAYS)
    index = cohort.index_stay(stays)
    got = {r[0]: r[2] for r in labels.label_readmission(index, stays).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_early_outcomes_are_excluded(frame):
    stays = frame(
        [
            (1, 1, "2020-01-01 00:00:00", "2020-01-05 00:00:00", "2020-01-02 00:00:00", None),
            (2, 2, "2020-01-01 00:00:00", "2020-01-05 00:00:00", None, None),
            (3, 3, "2020-01-01 00:00:00", "2020-01-05 00:00:00", None, None),
        ],
        STAYS,
    )
    people = frame(
        [(1, None), (2, "2019-06-01 00:00:00"), (3, None)], "entity_id bigint, dod ts"
    )
    index = cohort.min_stay(cohort.with_los(stays))
    assert ids(labels.label_table(index, stays, people)) == [3]


def test_prevalence(frame):
    df = frame([(1, 0, 5), (0, 0, 6), (1, 0, 5), (0, 1, 5)], "a int, b int, c int")
    got = {r["target"]: r for r in labels.prevalence(df, ("a", "b", "c")).collect()}
    assert got["a"]["prevalence"] == 0.5 and got["a"]["pos_weight"] == 1.0
    assert got["b"]["is_binary"] == 1 and got["c"]["is_binary"] == 0


def test_attrition_and_membership(stays, frame):
    steps = cohort.attrition({"all": stays, "first": cohort.index_stay(stays)})
    assert [(r["step"], r["n_rows"], r["n_entities"]) for r in steps.orderBy("ordinal").collect()] == [
        ("all", 6, 3), ("first", 3, 3),
    ]
    empty = frame([], "entity_id bigint")
    assert cohort.within_cohort(stays, empty).count() == 0


EVENTS = "stay_id bigint, event_id bigint, t ts, item_id bigint"


@pytest.fixture
def events(frame):
    times_ = [
        "2020-01-01 10:05:00", "2020-01-01 09:59:00", "2020-01-03 10:29:00",
        "2020-01-03 10:30:00", "2020-01-03 10:59:59", "2020-01-03 11:00:00", None,
    ]
    return frame([(1, i, t, i % 2) for i, t in enumerate(times_)], EVENTS)


@pytest.fixture
def anchor(frame):
    return frame([(1, 7, "2020-01-01 10:30:00")], "stay_id bigint, entity_id bigint, admit ts")


def test_clock_hour_window(events, anchor):
    got = window.early_window(events, anchor)
    assert ids(got, "event_id") == [0, 2, 3, 4]


def test_elapsed_window(events, anchor):
    assert ids(window.early_window(events, anchor, mode="elapsed"), "event_id") == [2]
    with pytest.raises(ValueError):
        window.early_window(events, anchor, mode="other")


def test_scan_bounds_change_nothing(events, anchor):
    got = window.early_window(events, anchor, carry=["entity_id"], prune_scan=True)
    assert ids(got, "event_id") == [0, 2, 3, 4]
    assert {r["entity_id"] for r in got.collect()} == {7}


def test_join_items_inner_and_left(events, frame):
    items = frame([(0, "heart rate")], "item_id bigint, item_label string")
    assert window.join_items(events, items).count() == 4
    left = window.join_items(events, items, how="left")
    assert left.count() == 7 and left.filter("item_label is null").count() == 3


def test_compliance(events, anchor):
    kept = window.early_window(events, anchor).withColumn("modality", F.lit("m"))
    row = window.window_compliance(kept).first()
    assert row["n_events"] == 4 and row["n_outside"] == 3
    assert row["max_boundaries"] == 48 and row["max_offset_hours"] > 48


@pytest.mark.parametrize("mode", ["first_row", "first_non_null"])
def test_index_stay_needs_no_sort_of_the_stays(spark, mode):
    stays = spark.range(100).select(
        (F.col("id") % 7).alias("entity_id"), (F.col("id") - 50).alias("stay_id"),
        F.timestamp_seconds(F.col("id") % 5 * 86400 - 10**9).cast("timestamp_ntz").alias("admit"),
        F.col("id").cast("string").alias("note"),
    )
    out = cohort.index_stay(stays, mode=mode)
    text = out._jdf.queryExecution().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text
    rows = sorted(stays.collect(), key=lambda r: (r["admit"], r["stay_id"]))
    first = {}
    for r in rows:
        first.setdefault(r["entity_id"], r)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, first.values()))
    one = cohort.one_per_entity(stays, "entity_id", ["admit", "stay_id"])
    assert "SortAggregate" not in one._jdf.queryExecution().toString()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, first.values()))


def test_repeated_and_missing_keys_still_give_one_stay(spark):
    rows = [(1, 5, None, "a"), (1, -3, None, "b"), (1, -3, None, "c"), (2, None, "2020-01-01 00:00:00", "d"),
            (2, 4, "2020-01-01 00:00:00", "e"), (None, 1, "1900-01-01 00:00:00", "f"), (3, 1, "2020-01-01 00:00:00", "g")]
    rows.append(rows[-1])
    stays = spark.createDataFrame(rows, "entity_id bigint, stay_id bigint, admit string, note string")
    stays = stays.withColumn("admit", F.col("admit").cast("timestamp_ntz"))
    got = {r["entity_id"]: r for r in cohort.index_stay(stays).collect()}
    assert set(got) == {1, 2, 3, None} and cohort.index_stay(stays).count() == 4
    assert got[1]["stay_id"] == -3 and got[2]["note"] == "d" and got[None]["note"] == "f"


def test_order_key_keeps_the_order(spark):
    rng = random.Random(1)
    from staylens.functions.hashing import order_key

    pairs = {(rng.choice([None, -(2**50), -1, 0, 7, 2**57]), rng.choice([-(2**63), -9, 0, 3, 2**63 - 1])) for _ in range(200)}
    df = spark.createDataFrame(sorted(pairs, key=str), "t bigint, i bigint")
    got = [tuple(r) for r in df.orderBy(order_key(F.col("t"), F.col("i"))).collect()]
    assert got == sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
