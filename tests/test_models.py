import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import explain, metrics, models
from staylens.plans import build

SMALL = {"maxIter": 3, "maxDepth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = []
    for i in range(240):
        y = int(rng.random() < 0.3)
        x = y + rng.gauss(0, 0.8)
        data.append((i, y, None if i % 17 == 0 else x, rng.random(), ("train", "val", "test")[i % 3]))
    return spark.createDataFrame(
        data, "entity_id bigint, y int, `m:x.1__mean` double, noise double, split string"
    ).cache()


NAMES = ["m:x.1__mean", "noise"]


def test_baseline_and_weights(rows, spark):
    fitted = models.baseline_logistic(rows.filter("split = 'train'"), NAMES, max_iter=20)
    scored = models.predict(fitted, rows.filter("split = 'val'"))
    assert metrics.roc_auc(scored).first()["auc"] > 0.7
    weights = {r["feature"]: r["weight"] for r in models.logistic_weights(fitted, NAMES, spark).collect()}
    assert weights["m:x.1__mean"] > abs(weights["noise"])


def test_target_fit_calibrates_monotonically(rows, tmp_path):
    fitted = models.fit_target(rows, NAMES, SMALL, with_full=True)
    scored = models.predict(fitted.base, rows.filter("split = 'test'"), "raw")
    cal = models.calibrate(scored, fitted.calibrator, "raw", "cal")
    pairs = sorted((r["raw"], r["cal"]) for r in cal.select("raw", "cal").collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:]))
    assert all(0 <= c <= 1 for _, c in pairs) and 0.01 <= fitted.threshold <= 0.9
    fitted.base.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = models.predict(PipelineModel.load(str(tmp_path / "m")), rows.filter("split = 'test'"), "raw")
    key = lambda r: r["entity_id"]
    assert [r["raw"] for r in sorted(again.collect(), key=key)] == [
        r["raw"] for r in sorted(scored.collect(), key=key)
    ]


def test_isotonic_matches_pool_adjacent_violators(spark):
    rng = random.Random(4)
    data = [(rng.randrange(30) / 30, int(rng.random() < 0.5)) for _ in range(200)]
    df = spark.createDataFrame(data, "p_raw double, y int")
    fitted = models.fit_calibrator(df)
    got = {r["p_raw"]: r["p"] for r in models.calibrate(df, fitted).collect()}
    blocks = []
    for s in sorted({p for p, _ in data}):
        ys = [y for p, y in data if p == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    for total, n, scores in blocks:
        for s in scores:
            assert got[s] == pytest.approx(total / n)
    outside = spark.createDataFrame([(-1.0,), (2.0,)], "p_raw double")
    low, high = (r["p"] for r in models.calibrate(outside, fitted).orderBy("p_raw").collect())
    assert low == min(got.values()) and high == max(got.values())


def test_missing_calibrator_keeps_raw(frame):
    df = frame([(0.3,)], "p_raw double")
    assert models.calibrate(df, None).first()["p"] == 0.3


def test_tuning_is_seeded(rows):
    ranges = {**models.SEARCH_RANGES, "maxIter": (2, 3, "int"), "maxDepth": (2, 2, "int")}
    assert models.draw_params(3, 1, ranges) == models.draw_params(3, 1, ranges)
    trials = models.draw_params(1, 1, ranges)
    out = models.tune(rows, NAMES, trials, 2, rungs=(1.0,))
    found = out.scores.collect()
    assert len(found) == 1 and found[0]["n_folds"] == 2 and found[0]["mean_auc"] > 0.6
    assert out.best == trials[0] and out.best_auc == found[0]["mean_auc"]
    assert set(models.draw_params(1)[0]) == set(models.SEARCH_RANGES)


def test_poor_trials_stop_early(rows):
    """A rung keeps its better third, and only those run all their iterations."""
    trials = [{"maxIter": 4, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 1, "stepSize": 1e-3}, {"maxIter": 2, "maxDepth": 1}]
    out = models.tune(rows, NAMES, trials, 2, rungs=(0.5, 1.0), workers=3)
    found = {(r["rung"], r["trial"]): r for r in out.scores.collect()}
    assert {t for rung, t in found if rung == 0} == {0, 1, 2}
    (last,) = [t for rung, t in found if rung == 1]
    first = max((r["mean_auc"], -t) for (rung, t), r in found.items() if rung == 0)
    assert last == -first[1] and out.best == trials[last] and out.best_auc == found[1, last]["mean_auc"]
    again = models.tune(rows, NAMES, trials, 2, rungs=(0.5, 1.0), workers=1)
    assert again.best == out.best and again.best_auc == pytest.approx(out.best_auc)
    with pytest.raises(ValueError):
        models.tune(rows, NAMES, trials, 2, rungs=(0.5,))


def test_tune_pick_refit(rows):
    small = {"maxIter": (2, 3, "int"), "maxDepth": (1, 2, "int")}
    fitted, tuned = models.tune_target(rows, NAMES, 2, ranges=small, folds=2, rungs=(1.0,), with_full=False)
    assert fitted.base.stages[-1].getMaxIter() == tuned.best["maxIter"] and fitted.full is None
    assert 0.01 <= fitted.threshold <= 0.9


def test_importances(rows, spark):
    train = rows.withColumnRenamed("m:x.1__mean", "x").fillna(0.0)
    fitted = models.boosted_trees(train, ["x", "noise"], SMALL)
    gains = models.gain_importance(fitted, ["x", "noise"], spark).collect()
    assert gains[0]["feature"] == "x" and sum(r["gain"] for r in gains) == pytest.approx(1.0)
    out = explain.permutation_importance(train, ["x", "noise"], lambda d: models.predict(fitted, d))
    got = {r["feature"]: r["importance"] for r in out.collect()}
    assert got["x"] > got["noise"] and got["x"] > 0.05


# --- end to end ------------------------------------------------------------
@pytest.fixture(scope="module")
def hospital(spark):
    rng = random.Random(11)
    stays, people, vitals, labs, rx, proc = [], [], [], [], [], []
    for e in range(1, 91):
        day = rng.randrange(1, 20)
        days = rng.randrange(3, 16)
        start, end = f"2020-01-{day:02d} 10:30:00", f"2020-02-{days + 5:02d} 10:30:00"
        sick = rng.random()
        stays.append((e, e * 10, start, end, None, "WHITE" if e % 2 else "ASIAN"))
        if sick > 0.6:
            stays.append((e, e * 10 + 1, f"2020-02-{days + 7:02d} 00:00:00", "2020-04-01 00:00:00", None, None))
        dod = "2020-02-25 00:00:00" if sick > 0.8 else None
        people.append((e, "M" if e % 3 else "F", "1960-05-05 00:00:00", dod))
        for k in range(3):
            t = f"2020-01-{day:02d} {11 + k}:00:00"
            vitals.append((e * 100 + k, e * 10, 1, t, 60 + 40 * sick + k))
            labs.append((e * 100 + k, e * 10, 5 if e % 4 else 99, t, 1.0 + sick))
        rx.append((e * 10, f"2020-01-{day:02d} 12:00:00", "Insulin" if e % 5 == 0 else "aspirin"))
        proc.append((e * 10, 2 if e % 6 == 0 else 77, f"2020-01-{day:02d} 12:00:00"))

    def stamped(data, schema, *names):
        df = spark.createDataFrame(data, schema)
        return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})

    sources = build.Sources(
        stays=stamped(stays, "entity_id bigint, stay_id bigint, admit string, disch string, deathtime string, ethnicity string", "admit", "disch", "deathtime"),
        entities=stamped(people, "entity_id bigint, gender string, dob string, dod string", "dob", "dod"),
        vitals=stamped(vitals, "event_id bigint, stay_id bigint, item_id bigint, t string, value double", "t"),
        labs=stamped(labs, "event_id bigint, stay_id bigint, item_id bigint, t string, value double", "t"),
        rx=stamped(rx, "stay_id bigint, t string, drug string", "t"),
        proc=stamped(proc, "stay_id bigint, item_id bigint, t string", "t"),
        items=spark.createDataFrame([(1, "Heart Rate"), (2, "Ventilation")], "item_id bigint, item_label string"),
        lab_items=spark.createDataFrame([(5, "Lactate")], "item_id bigint, item_label string"),
    )
    config = build.Config(min_support=5, prolonged_days=30)
    return sources, config, build.build_training(sources, None, config)


def test_training_build(hospital):
    _, _, training = hospital
    names = set(training.names)
    assert {"vitals:heart rate__mean", "labs:lactate__mean", "age"} <= names | {"age"}
    assert "proc_vent_any" in names and "rx_any_insulin" in names
    assert not any("los_hours" in n for n in names)
    assert "vitals:heart rate__measured" not in names  # measured for everybody: constant
    counts = {r["modality"]: r["n_entities"] for r in training.counts.collect()}
    assert counts["labelled"] == training.labels.count() == training.index.count()
    wide = build.training_rows(training)
    assert wide.count() == training.labels.count()
    assert wide.filter("`labs:lactate__mean` is null").count() > 0


def test_scoring(hospital):
    sources, config, training = hospital
    vectors, schema = build.training_vectors(training)
    fitted = build.fit_all(vectors, params={t: SMALL for t in build.TARGETS})
    out = build.score_unseen(sources, [1, 2, 3, 4], fitted, schema, config)
    assert out.columns == ["entity_id", "mortality_proba", "prolonged_LOS_proba", "readmission_proba"]
    rows = out.collect()
    assert [r["entity_id"] for r in rows] == [1, 2, 3, 4]  # a small batch keeps every column
    assert all(0 <= r[c] <= 1 for r in rows for c in out.columns[1:])
    labelled = build.score_unseen(
        sources, sources.entities, fitted, schema, config, require_labels=True
    )
    assert labelled.count() == training.labels.count()
    with pytest.raises(ValueError):
        build.score_unseen(sources, [], fitted, schema, config)


def test_scoring_of_wide_rows(hospital):
    """A small schema may also go through columns; the models then impute by themselves."""
    sources, config, training = hospital
    wide = build.training_rows(training)
    fitted = build.fit_all(wide, training.names, {t: SMALL for t in build.TARGETS})
    out = build.score_unseen(sources, [1, 2], fitted, training.names, config).collect()
    assert [r["entity_id"] for r in out] == [1, 2]
    assert all(0 <= r[c] <= 1 for r in out for c in ("mortality_proba", "readmission_proba"))
