import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import fairness
from tests.test_metrics import brute_auc


@pytest.fixture
def scored(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        group = "small" if i < 29 else "edge" if i < 59 else "none" if i < 100 else "big"
        y = 0 if group == "none" else int(rng.random() < 0.5)
        rows.append(("t", i, y, min(1.0, y * 0.2 + rng.random()), group, float(i % 100)))
    return spark.createDataFrame(
        rows, "target string, id bigint, y int, p double, g string, age double"
    ).withColumn("threshold", F.lit(0.6))


def test_group_metrics(scored):
    rows = [(r["g"], r["y"], r["p"]) for r in scored.collect()]
    out = fairness.group_metrics(scored, {"g": F.col("g")})
    got = {r["group_value"]: r for r in out.collect()}
    assert {g for g in got if not got[g]["small"]} == {"edge", "none", "big"}
    assert got["small"]["small"] and got["small"]["n"] == 29 and got["edge"]["n"] == 30
    assert {r["cohort_n"] for r in got.values()} == {200}
    everyone = brute_auc([(y, p) for _, y, p in rows])
    for name in ("edge", "big"):
        auc = brute_auc([(y, p) for g, y, p in rows if g == name])
        assert got[name]["auc"] == pytest.approx(auc)
        assert got[name]["global_auc"] == pytest.approx(everyone)
        assert got[name]["delta_auc"] == pytest.approx(auc - everyone)
    none = got["none"]
    assert none["auc"] is None and none["f1"] is None and none["pr_auc"] is None
    assert none["delta_auc"] is None and none["recall"] == 0.0
    assert none["prevalence"] == 0.0 and none["prob_source"] == "score"


def test_single_class_target_has_no_auc(scored):
    flat = scored.withColumn("y", F.lit(0))
    got = fairness.group_metrics(flat, {"g": F.col("g")}).collect()
    assert len(got) == 4 and {r["auc"] for r in got} == {None}


def test_groups_of_a_wide_frame(frame):
    df = frame(
        [(1, 1, 0, 1, 95.0), (2, 0, 1, 0, None)],
        "id bigint, gender_M int, gender_F int, eth_ASIAN int, age double",
    )
    out = fairness.explode_groups(df, fairness.demographic_groups(df))
    got = {(r["id"], r["group_category"], r["group_value"]) for r in out.collect()}
    assert got == {
        (1, "gender", "M"), (1, "ethnicity", "ASIAN"), (1, "age_band", "80+"), (2, "gender", "F"),
    }


METRICS = "target string, group_category string, group_value string, n bigint, prevalence double, auc double, delta_auc double, delta_f1 double"


@pytest.fixture
def table(frame):
    return frame(
        [
            ("a", "gender", "F", 40, 0.1, 0.8, 0.06, 0.0), ("a", "gender", "M", 60, 0.1, 0.7, 0.05, None),
            ("b", "gender", "F", 41, 0.1, 0.8, None, -0.2), ("a", "age_band", "80+", 50, 0.1, 0.6, 0.0, 0.0),
            ("a", "age_band", "1-20", 50, 0.1, 0.6, None, None), ("a", "age_band", "20-30", 5, 0.2, 0.6, 0.0, 0.01),
        ],
        METRICS,
    )


def test_support(table):
    whole = table.withColumn("cohort_n", F.lit(200))
    got = {r["group_value"]: (r["n"], r["pct"]) for r in fairness.support(whole).collect()}
    assert got["F"] == (41, 20.5) and got["M"] == (60, 30.0) and got["20-30"] == (5, 2.5)


def test_flags_overview_matrix_order(table):
    flagged = [(r["target"], r["group_value"]) for r in fairness.flags(table).collect()]
    assert flagged == [("a", "F"), ("b", "F")]  # strictly above the limit, NULL never flags
    row = fairness.overview(table).filter("target = 'a' and group_category = 'gender'").first()
    assert (row["groups"], row["min_n"], row["max_n"]) == (2, 40, 60)
    assert row["mean_delta_auc"] == pytest.approx(0.055)
    cells = {r["group_value"]: (r["a"], r["b"]) for r in fairness.matrix(table, ["a", "b"]).collect()}
    assert cells["F"] == (0.8, 0.8) and cells["M"] == (0.7, None)
    order = [r["group_value"] for r in fairness.ordered(table).filter("target = 'a'").collect()]
    assert order == ["1-20", "20-30", "80+", "M", "F"]
    assert fairness.prevalence_relation(table).count() == 6


def audit_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        sick = int(rng.random() < 0.4)
        rows.append((i, sick, 1, min(1.0, sick * 0.3 + rng.random() * 0.7), rng.random(), i % 2, 1 - i % 2, int(i % 3 == 0), float(i % 90)))
    return rows, spark.createDataFrame(
        rows, "entity_id bigint, died int, one_class int, p double, q double, gender_M int, gender_F int, eth_white int, age double"
    )


def test_fairness_table_in_one_call(spark):
    rows, df = audit_rows(spark)
    test = df.filter("entity_id % 4 = 0").select("entity_id")
    targets = {"mortality": ("died", "p"), "flat": ("one_class", "q")}
    out = fairness.fairness_table(df, targets, {"mortality": 0.5}, test_ids=test, small_n=10)
    got = out.collect()
    kept = [r for r in rows if r[0] % 4 == 0]
    assert {r["target"] for r in got} == {"mortality"}  # one class has no table
    assert [(r["group_category"], r["group_value"]) for r in got] == sorted(
        (r["group_category"], r["group_value"]) for r in got
    )
    assert {r["cohort_n"] for r in got} == {40} and {r["threshold"] for r in got} == {0.5}
    male = [(r[1], r[3]) for r in kept if r[5]]
    # Every fourth id is even, so one of the two has no rows and no group.
    assert not male and {r["group_value"] for r in got if r["group_category"] == "gender"} == {"F"}
    white = next(r for r in got if r["group_category"] == "ethnicity")
    chosen = [(r[1], r[3]) for r in kept if r[7]]
    assert white["n"] == len(chosen) and white["auc"] == pytest.approx(brute_auc(chosen))
    assert white["delta_auc"] == pytest.approx(brute_auc(chosen) - brute_auc([(r[1], r[3]) for r in kept]))


def test_fairness_table_derives_thresholds_and_refuses(spark):
    _, df = audit_rows(spark)
    targets = {"mortality": ("died", "p")}
    whole = fairness.fairness_table(df, targets, {"mortality": float("nan")}, test_only=False)
    scored = df.select(F.lit("t").alias("target"), F.col("died").alias("y"), "p")
    from staylens.operators.metrics import derive_threshold

    wanted = derive_threshold(scored).first()["threshold"]
    assert {r["threshold"] for r in whole.collect()} == {wanted}
    with pytest.raises(ValueError, match="test split"):
        fairness.fairness_table(df, targets)
    with pytest.raises(ValueError, match="two classes"):
        fairness.fairness_table(df, {"flat": ("one_class", "q")}, test_only=False)
