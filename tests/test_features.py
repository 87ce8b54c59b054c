import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.operators import explain, features, prune
from staylens.operators.prune import QualityError

EVENTS = "entity_id bigint, event_id bigint, label string, value string, t ts"


@pytest.fixture
def events(frame):
    return frame(
        [
            (1, 1, "  Heart Rate ", "80", "2020-01-01 00:00:00"),
            (1, 2, "heart rate", "90", "2020-01-01 01:00:00"),
            (1, 3, "heart rate", "70", "2020-01-01 01:00:00"),
            (1, 4, "heart rate", "abc", "2020-01-01 05:00:00"),
            (1, 5, "heart rate", "nan", "2020-01-01 05:00:00"),
            (2, 6, "heart rate", "1.5", "2020-01-01 00:00:00"),
            (2, 7, None, "3", "2020-01-01 00:00:00"),
            (2, 8, "12345", "3", "2020-01-01 00:00:00"),
            (3, 9, "temp", "37", None),
            (4, 10, "temp", "37", "2020-01-01 00:00:00"),
        ],
        EVENTS,
    )


def stats_of(events, **kwargs):
    rows = features.event_stats(events, **kwargs).collect()
    return {(r["entity_id"], r["label"]): r for r in rows}


def test_event_stats(events):
    got = stats_of(events)
    assert set(got) == {(1, "heart rate"), (2, "heart rate"), (2, "none"), (4, "temp")}
    hr = got[(1, "heart rate")]
    assert (hr["mean"], hr["min"], hr["max"], hr["range"], hr["count"]) == (80, 70, 90, 20, 3)
    assert hr["std"] == pytest.approx(10.0)  # sample deviation
    assert hr["last"] == 70  # equal times: the larger event id
    assert got[(2, "heart rate")]["std"] is None


def test_mean_and_deviation_do_not_follow_the_order(spark):
    """the last bits followed the order, so a value beside a tie was rounded either way."""
    made = random.Random(3)
    groups = [[made.randint(90_000, 10_500_000) / 100 for _ in range(n)] for n in (2, 3, 3, 4, 7, 40) * 20]
    groups += [[made.uniform(0.01, 500) for _ in range(5)] for _ in range(20)]
    groups += [[1.5 * 2**-20 - 2**-60, 1.5 * 2**-20 + 2**-60], [-3.25, -3.25, -3.25], [0.1, 0.1]]
    rows = [
        (10 * i + k, j, "a", value, "2020-01-01 00:00:00")
        for i, group in enumerate(groups)
        for k, order in enumerate((group, group[::-1], sorted(group), sorted(group)[::-1]))
        for j, value in enumerate(order)
    ]
    table = pd.DataFrame(rows, columns=["entity_id", "event_id", "label", "value", "t"])
    got = stats_of(spark.createDataFrame(table).coalesce(1))
    for i, group in enumerate(groups):
        found = {(got[10 * i + k, "a"]["mean"], got[10 * i + k, "a"]["std"]) for k in range(4)}
        assert len(found) == 1
        mean, std = found.pop()
        exact = [Fraction(x) for x in group]
        middle = sum(exact) / len(exact)
        var = sum((x - middle) ** 2 for x in exact) / (len(exact) - 1)
        assert mean == pytest.approx(float(middle), rel=4e-16)
        assert std == pytest.approx(math.sqrt(var), rel=4e-16, abs=0)


def test_moments_beyond_exact_sums(spark):
    """Values of finer bits, huge or infinite ones keep the engine's own moments."""
    for values in ([1e-7, 5e-7], [3e15, 1e15], [1e12] * 70 + [3e12], [math.inf, 1.0], [0.25]):
        table = pd.DataFrame({"entity_id": 1, "event_id": range(len(values)), "label": "a", "value": values})
        (row,) = stats_of(spark.createDataFrame(table.assign(t="2020-01-01 00:00:00"))).values()
        assert row["mean"] == pytest.approx(np.mean(values))
        if len(values) == 1:
            assert row["std"] is None
        elif math.isfinite(sum(values)):
            assert row["std"] == pytest.approx(np.std(values, ddof=1))


def test_last_value_with_a_text_tie(events):
    other = events.withColumn("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    assert stats_of(other)[(1, "heart rate")]["last"] == 70


def test_label_cap_counts_before_digit_labels_drop(frame):
    rows = [(1, i, "9", "1", "2020-01-01 00:00:00") for i in range(3)]
    rows += [(1, 10 + i, "b", "1", "2020-01-01 00:00:00") for i in range(2)]
    rows += [(1, 20 + i, "a", "1", "2020-01-01 00:00:00") for i in range(2)]
    got = stats_of(frame(rows, EVENTS), max_labels=2)
    assert set(got) == {(1, "a")}  # "9" took a slot, ties go by label
    assert set(stats_of(frame(rows, EVENTS), labels=["b"])) == {(1, "b")}


def test_measured_zeros_stay_inside_the_modality(events, frame):
    vitals = features.stats_to_long(features.event_stats(events), "vitals")
    labs_rows = [(5, 1, "temp", "38", "2020-01-01 00:00:00")]
    labs = features.stats_to_long(features.event_stats(frame(labs_rows, EVENTS)), "labs")
    long = features.to_long([vitals, labs])
    names = ["vitals:temp__measured", "labs:temp__measured", "vitals:temp__mean"]
    wide = {r["entity_id"]: r for r in features.to_wide(long, names).collect()}
    assert [wide[i]["vitals:temp__measured"] for i in (1, 2, 4, 5)] == [0, 0, 1, None]
    assert [wide[i]["labs:temp__measured"] for i in (1, 5)] == [None, 1]
    filled = features.to_wide(long, names, fill=0.0)
    assert filled.filter("`vitals:temp__mean` is null").count() == 0


def test_long_wide_long_round_trip(events):
    long = features.stats_to_long(features.event_stats(events), "v")
    long = long.filter(F.col("stat") != "measured")
    names = sorted(r[0] for r in long.select("feature").distinct().collect())
    back = features.block_to_long(features.to_wide(long, names), "v")
    key = lambda r: (r["entity_id"], r["feature"])
    cells = lambda df: sorted(
        [(r["entity_id"], r["feature"], r["value"]) for r in df.collect()]
    )
    assert cells(back) == cells(long) and key


def test_vector_and_align(events):
    long = features.stats_to_long(features.event_stats(events), "v")
    names = ["v:heart rate__mean", "v:absent__mean"]
    vectors = {r["entity_id"]: list(r["features"]) for r in features.to_vector(long, names).collect()}
    assert vectors[1] == [80.0, 0.0]
    wide = features.to_wide(long, ["v:temp__mean", "v:heart rate__mean"])
    aligned = features.align(wide, names)
    assert aligned.columns == ["entity_id", *names]
    assert aligned.filter("`v:absent__mean` <> 0").count() == 0


def test_counts_and_flags(frame):
    rows = [(1, "Insulin Human"), (1, "insulin human"), (1, None), (2, "CefTRIAXone"), (3, "x")]
    got = {r["entity_id"]: r for r in features.count_and_flags(
        frame(rows, "entity_id bigint, drug string")).collect()}
    assert (got[1]["rx_total_mentions"], got[1]["rx_unique_drugs"]) == (3, 2)
    assert (got[1]["rx_any_insulin"], got[1]["rx_any_abx"]) == (1, 0)
    assert got[2]["rx_any_abx"] == 1 and got[3]["rx_any_steroid"] == 0


def test_procedure_label_fallback(frame):
    with_label = frame(
        [(1, None, "Ventilation"), (2, "CRRT", "other")],
        "entity_id bigint, item_label string, order_description string",
    )
    got = {r["entity_id"]: r for r in features.procedure_flags(with_label).collect()}
    assert got[1]["proc_vent_any"] == 0 and got[2]["proc_rrt_any"] == 1
    got = {r["entity_id"]: r for r in features.procedure_flags(with_label.drop("item_label")).collect()}
    assert got[1]["proc_vent_any"] == 1


def test_demographics_defaults(frame):
    index = frame([(1, "2100-01-01 00:00:00"), (2, "2100-01-01 00:00:00")], "entity_id bigint, admit ts")
    bare = frame([(1,)], "entity_id bigint")
    got = features.demographics(index, bare).collect()
    assert all(r["age"] == 65 and r["gender_M"] == 0 and r["eth_OTHER"] == 1 for r in got)
    people = frame([(1, "m", "2060-01-01 00:00:00")], "entity_id bigint, gender string, dob ts")
    got = {r["entity_id"]: r for r in features.demographics(index, people).collect()}
    assert got[1]["gender_M"] == 1 and got[2]["gender_M"] == 0 and got[2]["age"] == 65


def test_leakage_and_provenance(frame):
    block = frame([(1, 5.0, 1.0, 2.0)], "entity_id bigint, LOS_HOURS_raw double, f__count double, g double")
    digits = block.withColumn("77", F.lit(1.0))
    long = features.to_long([features.block_to_long(digits, "b")])
    assert {r["feature"] for r in long.collect()} == {"f__count", "g"}
    raw = features.block_to_long(digits, "b")
    assert [r[0] for r in features.leakage_names(raw).collect()] == ["LOS_HOURS_raw"]
    got = {r["feature"]: r["group"] for r in features.provenance(long).collect()}
    assert got == {
        "f__count": "missingness", "g": "baseline",
        "__feature_schema_version__": "2025-missingness-v1",
    }


# --- pruning ---------------------------------------------------------------
def random_wide(seed=3, n=60):
    rng = random.Random(seed)
    data = {
        "plain": [rng.random() for _ in range(n)],
        "gaps": [rng.random() if rng.random() < 0.4 else None for _ in range(n)],
        "constant": [2.0] * n,
        "constant_gaps": [2.0 if i % 2 else None for i in range(n)],
        "support9": [float(i) if i < 9 else None for i in range(n)],
        "support10": [float(i) if i < 10 else None for i in range(n)],
        "all_null": [None] * n,
    }
    return pd.DataFrame(data, dtype="float64")


def wide_to_long(spark, wide):
    rows = [
        (int(i), "m", None, None, c, float(v))
        for c in wide.columns
        for i, v in wide[c].items()
        if not np.isnan(v)
    ]
    return spark.createDataFrame(
        rows, "entity_id bigint, modality string, label string, stat string, feature string, value double"
    )


def test_profile_matches_mean_imputed_variance(spark):
    wide = random_wide()
    profile = prune.feature_profile(wide_to_long(spark, wide), len(wide))
    got = {r["feature"]: r for r in profile.collect()}
    assert "all_null" not in got
    for c in wide.columns.drop("all_null"):
        want = wide[c].fillna(wide[c].mean()).var(ddof=0)
        assert got[c]["variance"] == pytest.approx(want, abs=1e-12)
        assert got[c]["support"] == wide[c].notna().sum()
    assert not got["constant"]["is_variable"] and not got["constant_gaps"]["is_variable"]


def test_profile_of_measured_features(spark, frame):
    rows = [(i, i, "a", "1", "2020-01-01 00:00:00") for i in range(6)]
    rows += [(i, 10 + i, "b", "1", "2020-01-01 00:00:00") for i in range(2)]
    long = features.stats_to_long(features.event_stats(frame(rows, EVENTS)), "v")
    got = {r["feature"]: r for r in prune.feature_profile(long, 10).collect()}
    cells = np.array([1, 1, 0, 0, 0, 0] + [np.nan] * 4)
    filled = np.where(np.isnan(cells), np.nanmean(cells), cells)
    b = got["v:b__measured"]
    assert b["support"] == 6 and b["variance"] == pytest.approx(filled.var())
    assert b["min_value"] == 0 and b["is_variable"]
    assert not got["v:a__measured"]["is_variable"]


def test_prune_rules(spark):
    long = wide_to_long(spark, random_wide())
    kept = prune.prune(long, 60, 10)
    names = {r[0] for r in kept.select("feature").distinct().collect()}
    assert names == {"plain", "gaps", "support10"}
    again = prune.prune(kept, 60, 10)
    assert again.count() == kept.count()
    low = {r[0] for r in prune.prune(long, 60, 0, 0).select("feature").distinct().collect()}
    assert low == {"plain", "gaps", "support9", "support10"}
    default = {r[0] for r in prune.prune(long, 60).select("feature").distinct().collect()}
    assert default == low  # nothing but constants goes unasked
    report = prune.prune_report(prune.feature_profile(long, 60), 10).first()
    assert (report["zero_variance_dropped"], report["low_support_dropped"]) == (2, 1)


def test_top_k_score(spark):
    wide = random_wide().drop(columns=["constant", "constant_gaps", "all_null", "support9"])
    long = wide_to_long(spark, wide)
    var = pd.Series({c: wide[c].fillna(wide[c].mean()).var(ddof=0) for c in wide})
    sup = wide.notna().sum().astype(float)
    z = lambda s: (s - s.mean()) / (s.std() + 1e-12)
    want = (0.7 * z(var) + 0.3 * z(sup)).sort_values(ascending=False)
    got = prune.kept_features(prune.feature_profile(long, len(wide)), 10, 2).collect()
    assert {r["feature"] for r in got} == set(want.index[:2])
    for r in got:
        assert r["score"] == pytest.approx(want[r["feature"]])
    assert [r["ordinal"] for r in sorted(got, key=lambda r: r["feature"])] == [0, 1]


def test_health_profile(spark):
    import hashlib

    def cell(i, v):
        text = f"{i}:{v:.6f}:{prune.HASH_SEED}"
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    wide = random_wide()
    got = {r["feature"]: r for r in prune.health_profile(wide_to_long(spark, wide), 60).collect()}
    cells = wide["support10"].dropna()
    assert got["support10"]["values_hash"] == str(sum(cell(i, v) for i, v in cells.items()))
    wide.loc[59, "plain"] += 1.0  # the last entity counts like the first
    changed = prune.health_profile(wide_to_long(spark, wide), 60).filter("feature = 'plain'").first()
    assert changed["values_hash"] != got["plain"]["values_hash"]
    wide.loc[59, "plain"] -= 1.0
    assert got["gaps"]["n_unique"] == wide["gaps"].nunique()
    assert got["gaps"]["missing_frac"] == pytest.approx(wide["gaps"].isna().mean())
    assert got["constant"]["all_constant"] == 1
    assert got["plain"]["std_pop"] == pytest.approx(wide["plain"].std(ddof=0))


def test_guards(spark, frame):
    long = wide_to_long(spark, random_wide())
    share = prune.assert_variable_fraction(prune.variable_fraction(long, 60), 0.5)
    assert share == pytest.approx(4 / 6)
    with pytest.raises(QualityError):
        prune.assert_variable_fraction(prune.variable_fraction(long, 60), 0.9)
    nulls = prune.variable_fraction(long, 60, count_null=True).first()
    assert nulls["n_variable"] == 5  # a constant with gaps counts two values
    flat = frame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "entity_id bigint, a double, b double")
    assert prune.wide_variable_fraction(flat).first()["variable_fraction"] == 0.5
    with pytest.raises(QualityError):
        prune.assert_unique_ids(frame([(1,), (1,)], "entity_id bigint"))
    with pytest.raises(QualityError):
        prune.assert_unique_ids(frame([("x",)], "entity_id string"))
    prune.assert_unique_ids(frame([("1",), ("2",)], "entity_id string"))
    with pytest.raises(QualityError):
        prune.require_columns(flat, ["missing"])


def test_schema_guards(frame):
    old = frame([(i, f"f{i}") for i in range(10)], "ordinal int, feature string")
    prune.assert_schema_not_shrunk(old, old.filter("ordinal < 9"))
    with pytest.raises(QualityError):
        prune.assert_schema_not_shrunk(old, old.filter("ordinal < 8"))
    prune.assert_same_order(old, old)
    with pytest.raises(QualityError):
        prune.assert_same_order(old, old.withColumn("ordinal", F.lit(9) - F.col("ordinal")))
    diff = prune.schema_diff(old, old.filter("ordinal < 5")).first()
    assert diff["jaccard"] == 0.5


def test_parity(frame):
    a = frame([(1,), (2,)], "entity_id bigint")
    b = frame([(2,), (3,)], "entity_id bigint")
    row = prune.id_parity(a, b).first()
    assert (row["missing_in_features"], row["extra_in_features"], row["overlap_frac"]) == (1, 1, 0.5)
    with pytest.raises(QualityError):
        prune.assert_parity(a, b)
    prune.assert_parity(a, a)


def test_variance_collapse(spark):
    long = wide_to_long(spark, random_wide())
    after = long.filter("entity_id = 1")
    got = {r["feature"]: r["collapsed"] for r in prune.variance_collapse(long, after).collect()}
    assert got["plain"] == 1 and got["constant"] == 0


def test_single_feature_auc(frame):
    long = frame(
        [(i, "leak", float(i)) for i in range(4)] + [(i, "flat", 1.0) for i in range(4)],
        "entity_id bigint, feature string, value double",
    )
    labels = frame([(0, 1), (1, 1), (2, 0), (3, 0)], "entity_id bigint, y int")
    got = {r["feature"]: r for r in explain.single_feature_auc(long, labels).collect()}
    assert got["leak"]["auc"] == 0.0 and got["leak"]["strength"] == 1.0
    assert got["flat"]["auc"] == 0.5


@pytest.fixture
def halves(spark, frame):
    """Twenty entities measured once for ``a``, every second one also for ``b``."""
    rows = [(i, i, "a", str(i), "2020-01-01 00:00:00") for i in range(20)]
    rows += [(i, 100 + i, "b", "1", "2020-01-01 00:00:00") for i in range(0, 20, 2)]
    return features.stats_to_long(features.event_stats(frame(rows, EVENTS)), "v")


def test_implied_zeros_survive_pruning(halves):
    members = features.measured_members(halves)
    kept = prune.prune(halves, 20)
    names = sorted(r[0] for r in kept.select("feature").distinct().collect())
    assert "v:a__count" not in names and "v:b__measured" in names
    want = {tuple(r) for r in features.to_wide(halves, names).collect()}
    assert {tuple(r) for r in features.to_wide(kept, names, members=members).collect()} == want
    place = 1 + names.index("v:b__measured")
    assert sorted(r[place] for r in want) == [0.0] * 10 + [1.0] * 10


def test_health_counts_implied_zeros(halves):
    row = prune.health_profile(halves, 20).filter("feature = 'v:b__measured'").first()
    assert (row["min_value"], row["max_value"], row["std_pop"]) == (0.0, 1.0, 0.5)
    assert (row["n_unique"], row["missing_frac"], row["all_constant"]) == (2, 0.0, 0)


def test_collapse_of_measured_features(halves):
    for keep, share in (("entity_id % 2 = 0", "b only"), ("entity_id % 2 = 1", "none")):
        out = prune.variance_collapse(halves, halves.filter(keep))
        row = out.filter("feature = 'v:b__measured'").first()
        assert (row["var_before"], row["var_after"], row["collapsed"]) == (0.25, 0.0, 1), share


def test_measured_feature_that_equals_the_label(halves, frame):
    labels = frame([(i, 1 - i % 2) for i in range(20)], "entity_id bigint, y int")
    got = {r["feature"]: r for r in explain.single_feature_auc(halves, labels).collect()}
    assert got["v:b__measured"]["auc"] == 1.0 and got["v:a__measured"]["auc"] == 0.5


def test_baseline_table(frame):
    rows = frame(
        [("train", 1.0, 1, "a"), ("train", 3.0, 0, "b"), ("val", 2.0, 1, "a")],
        "split string, x double, y int, c string",
    )
    got = {r["characteristic"]: r for r in features.baseline_table(
        rows, ["x", "absent"], ["y"], ["c"]).collect()}
    assert got["x"]["train"] == "2.00 (1.41)" and got["y"]["train"] == "50.0%"
    assert got["c=b"]["train"] == "50.0%" and got["c=b"]["val"] is None
    assert "absent" not in got


def test_final_columns_and_modality_counts(frame):
    scored = frame([(2, 0.5), (1, 0.1)], "entity_id bigint, a double")
    out = features.final_columns(scored, ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(1, 0.1, None), (2, 0.5, None)]
    counts = features.modality_counts({"x": frame([(1,), (1,), (2,)], "entity_id bigint")}).first()
    assert (counts["n_rows"], counts["n_entities"]) == (3, 2)


def test_align_long_adds_absent_features(frame):
    long = frame([(1, "a", 1.0), (2, "b", 2.0), (2, "x", 9.0)], "entity_id bigint, feature string, value double")
    schema = frame([("a", 0), ("b", 1), ("c", 2)], "feature string, ordinal bigint")
    kept = features.align_long(long, schema)
    assert sorted((r["entity_id"], r["feature"]) for r in kept.collect()) == [(1, "a"), (2, "b")]
    whole = features.align_long(long, schema, 0.5)
    got = sorted((r["entity_id"], r["ordinal"], r["value"]) for r in whole.collect())
    assert got == [(1, 0, 1.0), (1, 2, 0.5), (2, 1, 2.0), (2, 2, 0.5)] and whole.columns == kept.columns
