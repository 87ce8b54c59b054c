import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.operators import metrics, ranking
from staylens.operators.sampling import poisson_limits, replicate_sums


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def brute_curve(rows):
    """(score, tp, fp) from the highest score down."""
    out = []
    for s in sorted({p for _, p in rows}, reverse=True):
        tp = sum(y == 1 and p >= s for y, p in rows)
        fp = sum(y == 0 and p >= s for y, p in rows)
        out.append((s, tp, fp))
    return out


def brute_ap(rows):
    total = sum(y for y, _ in rows)
    if not total:
        return None
    area, before = 0.0, 0
    for _, tp, fp in brute_curve(rows):
        area += (tp - before) / total * tp / (tp + fp)
        before = tp
    return area


def brute_trapezoid(rows):
    total = sum(y for y, _ in rows)
    xs, ys = [0.0], [1.0]
    for _, tp, fp in brute_curve(rows):
        xs.append(tp / total)
        ys.append(tp / (tp + fp))
    return sum((x1 - x0) * (y0 + y1) / 2 for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]))


def make(spark, rows):
    return spark.createDataFrame([(int(y), float(p)) for y, p in rows], "y int, p double")


def random_rows(seed, n=300, steps=40):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.3), rng.randrange(steps) / steps) for _ in range(n)]


def test_score_metrics_match_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        got = metrics.score_metrics(make(spark, rows)).first()
        assert got["auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
        assert got["pr_auc"] == pytest.approx(brute_ap(rows), abs=1e-12)
        assert got["pr_auc_trapezoid"] == pytest.approx(brute_trapezoid(rows), abs=1e-12)


def test_keys_weights_and_edge_scores(spark):
    rows = [("a", 1, 0.0, 2), ("a", 0, 1.0, 1), ("a", 0, 0.0, 1), ("b", 1, 1.0, 3), ("c", 0, 0.5, 1)]
    df = spark.createDataFrame(rows, "k string, y int, p double, w int")
    got = {r["k"]: r for r in metrics.score_metrics(df, keys=["k"], weight="w").collect()}
    assert got["a"]["auc"] == pytest.approx(0.25)
    assert got["b"]["auc"] is None and got["b"]["pr_auc"] == 1.0
    assert got["c"]["auc"] is None and got["c"]["pr_auc"] is None
    rep = [("a", 1, 0.0)] * 2 + [("a", 0, 1.0), ("a", 0, 0.0)]
    plain = spark.createDataFrame(rep, "k string, y int, p double")
    assert metrics.roc_auc(plain, keys=["k"]).first()["auc"] == got["a"]["auc"]


def test_any_real_score_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12)) for _ in range(200)]
    rows += [(1, 0.0), (0, -0.0), (1, float("inf")), (0, float("-inf"))]
    assert metrics.roc_auc(make(spark, rows)).first()["auc"] == pytest.approx(brute_auc(rows))


def test_close_scores_in_one_cell(spark):
    base = 0.123456
    rows = [(i % 3 == 0, base + i * 1e-13) for i in range(60)]
    assert metrics.roc_auc(make(spark, rows)).first()["auc"] == pytest.approx(brute_auc(rows))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=25))
def test_auc_mirror(spark, pairs):
    rows = [(y, p / 8) for y, p in pairs]
    df = make(spark, rows)
    forward = metrics.roc_auc(df).first()["auc"]
    back = metrics.roc_auc(df.withColumn("p", -F.col("p"))).first()["auc"]
    assert (forward is None) == (back is None)
    if forward is not None:
        assert forward == pytest.approx(1 - back)


def test_curves(spark):
    rows = random_rows(4, 80, 10)
    n_pos = sum(y for y, _ in rows)
    n_neg = len(rows) - n_pos
    roc = metrics.roc_curve(make(spark, rows)).collect()
    got = {(r["threshold"], round(r["fpr"], 12), round(r["tpr"], 12)) for r in roc}
    want = {(s, round(fp / n_neg, 12), round(tp / n_pos, 12)) for s, tp, fp in brute_curve(rows)}
    assert got == want | {(None, 0.0, 0.0)}
    pr = metrics.pr_curve(make(spark, rows)).collect()
    assert {(r["threshold"], round(r["precision"], 12)) for r in pr} == {
        (s, round(tp / (tp + fp), 12)) for s, tp, fp in brute_curve(rows)
    } | {(None, 1.0)}


def test_running_totals_on_hot_and_spread_values(spark):
    rng = random.Random(9)
    values = [0.5] * 500 + [rng.gauss(0, 3) for _ in range(400)]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n int")
    counts = df.groupBy("v").agg(F.sum("n").alias("n"))
    got = ranking.cumulative_values(counts, [], "v", ["n"]).collect()
    for r in got:
        assert r["cum_n"] == sum(v <= r["v"] for v in values)
        assert r["total_n"] == len(values)


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.5, rng.random()]) for _ in range(101)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "k string, v double")
    probs = [0.0, 0.025, 0.5, 0.61, 1.0]
    got = {(r["k"], r["ordinal"]): r["value"] for r in
           ranking.exact_quantiles(df, "v", probs, ["k"]).collect()}
    for i, q in enumerate(np.percentile(values, [p * 100 for p in probs])):
        assert got[("a", i)] == pytest.approx(q, abs=1e-12)
        assert got[("b", i)] == 7.0


def test_reliability_bins(spark):
    rows = random_rows(8, 200, 13)
    p = np.array([v for _, v in rows])
    y = np.array([v for v, _ in rows])
    edges = np.percentile(p, np.linspace(0, 1, 16) * 100)
    bins = np.searchsorted(edges[1:-1], p)
    for df_keys in ((), ("k",)):
        df = make(spark, rows).withColumn("k", F.lit("x"))
        got = {r["bin"]: r for r in metrics.reliability(df, 15, keys=df_keys).collect()}
        assert set(got) == set(bins.tolist())
        for b in got:
            assert got[b]["mean_predicted"] == pytest.approx(p[bins == b].mean())
            assert got[b]["observed_rate"] == pytest.approx(y[bins == b].mean())


def test_confusion_forms(spark):
    df = make(spark, [(1, 0.9), (0, 0.8), (1, 0.2), (0, 0.1)])
    row = metrics.cost_fbeta(metrics.confusion(df, 0.5)).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 1)
    assert row["cost"] == 6.0 and row["f1"] == pytest.approx(0.5, abs=1e-8)
    none = metrics.confusion(df, 2.0, zero_division="zero").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.confusion(df, 0.9).first()["tp"] == 1  # p >= thr


def test_best_threshold_matches_loop(spark):
    for seed, (low, high, n) in ((3, (0.01, 0.9, 300)), (4, (0.01, 0.99, 150))):
        rows = random_rows(seed, 150, 25)
        y = np.array([a for a, _ in rows])
        p = np.array([b for _, b in rows])
        step = (high - low) / (n - 1)
        best = (-1.0, None)
        for i in range(n):
            t = low + i * step
            pred = p >= t
            tp, fp, fn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum()
            f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
            if f1 > best[0]:
                best = (f1, t)
        got = metrics.best_threshold(make(spark, rows), low, high, n, zero_division="zero").first()
        assert got["threshold"] == best[1] and got["f1"] == pytest.approx(best[0])


def test_threshold_sweep_without_positives(spark):
    sweep = metrics.threshold_sweep(make(spark, [(0, 0.2), (0, 0.95)]))
    assert sweep.count() == 300
    best = metrics.best_threshold(make(spark, [(0, 0.2)])).first()
    assert best["f1"] == 0.0 and best["threshold"] == pytest.approx(0.01)
    assert metrics.derive_threshold(make(spark, [(1, 0.5)])).first()["f1"] == 1.0


def test_histogram_and_shift(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.05, 0.95), (1.0, 1.0)], "a double, b double")
    got = {(r["column"], r["bin"]): r["n"] for r in metrics.score_histogram(df, ["a", "b"]).collect()}
    assert len(got) == 20 and got[("a", 0)] == 2 and got[("a", 9)] == 1 and got[("b", 9)] == 3
    shift = metrics.calibration_shift(df, "a", "b").first()[0]
    assert shift == pytest.approx((1.0 + 0.9 + 0.0) / 3)


def test_bootstrap_difference(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        y = int(rng.random() < 0.4)
        rows.append(("t", i, y, y * 0.3 + rng.random(), rng.random()))
    df = spark.createDataFrame(rows, "target string, id bigint, y int, a double, b double")
    got = metrics.bootstrap_auc_diff(df, "a", "b", "id", n_rep=30, method="exact").first()
    pairs = lambda c: [(r[2], r[c]) for r in rows]
    assert got["auc_a"] == pytest.approx(brute_auc(pairs(3)))
    assert got["auc_b"] == pytest.approx(brute_auc(pairs(4)))
    assert got["ci_lower"] <= got["diff_a_minus_b"] <= got["ci_upper"]
    assert 0 < got["p_two_sided"] <= 1 and got["n_boot_effective"] == 30 and got["n_test"] == 120
    loose = metrics.bootstrap_auc_diff(df, "a", "b", "id", n_rep=30).first()
    again = metrics.bootstrap_auc_diff(df.repartition(5), "a", "b", "id", n_rep=30).first()
    assert again["ci_lower"] == pytest.approx(loose["ci_lower"], abs=1e-12)
    assert abs(loose["ci_lower"] - got["ci_lower"]) < 0.15


def poisson_weight(row_id, replicate, seed=42):
    digest = hashlib.sha256(f"{row_id}:{replicate // 8}:{seed}".encode()).hexdigest()
    return sum(digest[8 * (replicate % 8) :][:8] >= limit for limit in poisson_limits())


@pytest.mark.parametrize("chunk", [1, 3, 1 << 14])
def test_replicates_over_cells(spark, monkeypatch, chunk):
    """Weights summed per distinct score give the area of the weighted rows."""
    monkeypatch.setattr(metrics, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [("t", i, int(rng.random() < 0.4), rng.randrange(9) / 8) for i in range(70)]
    rows += [("one class", i, 1, 0.5) for i in range(3)]
    rows += [("t", 900, None, 0.5), ("t", 901, 1, None), ("t", 902, 0, float("nan"))]
    df = spark.createDataFrame(rows, "target string, id bigint, y int, p double")
    whole, drawn = metrics.replicate_aucs(df, "id", ["target"], 21)
    kept = [r for r in rows if r[0] == "t" and r[1] < 900]
    got = {r["target"]: r["auc"] for r in whole.collect()}
    assert got["one class"] is None and got["t"] == pytest.approx(brute_auc([r[2:] for r in kept]))
    found = {(r["target"], r["replicate"]): r["auc"] for r in drawn.collect()}
    assert len(found) == 42
    for b in range(21):
        many = [r[2:] for r in kept for _ in range(poisson_weight(r[1], b))]
        assert found["t", b] == pytest.approx(brute_auc(many))
        assert found["one class", b] is None


def test_replicates_shuffle_cells_not_rows(spark):
    """Rows that share a score are one vector before anything is shuffled."""
    df = spark.range(20_000).select(
        F.lit("t").alias("target"), "id", (F.col("id") % 2).alias("y"), (F.col("id") % 5 / 5).alias("p")
    )
    sums = replicate_sums(
        df.coalesce(2), "id", 16, ["target", "p"], {"pos": lambda w: w * F.col("y")}
    )
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")
    assert "Python" not in plan and sums.count() == 10


def test_a_key_is_hashed_once_for_all_its_rows(spark):
    """Targets and scores of a key share its weights; equal rows and missing keys count too."""
    rows = [(t, i, i % 2, p) for i in range(40) for t in ("s", "t") for p in (i % 3 / 3, i % 5 / 5)]
    rows += [("t", 7, 1, 0.5)] * 3 + [("s", None, 0, 0.5)] * 2
    df = spark.createDataFrame(rows, "target string, id bigint, y int, p double")
    sums = replicate_sums(df, "id", 16, ["target", "p"], {"pos": lambda w: w * F.col("y"), "n": lambda w: w})
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("explode(_rows") < text.index("sha2(") < text.index("collect_list(")
    wanted = {}
    for target, key, y, p in rows:
        for rep in range(16):
            digest = hashlib.sha256(":".join(str(v) for v in (key, rep // 8, 42) if v is not None).encode())
            at = digest.hexdigest()[rep % 8 * 8 : rep % 8 * 8 + 8]
            weight = sum(at >= limit for limit in poisson_limits())
            cell = wanted.setdefault((target, p, rep), [0, 0])
            cell[0] += weight * y
            cell[1] += weight
    got = {
        (r["target"], r["p"], r["block"] * 8 + j): [r[f"pos_{j}"], r[f"n_{j}"]]
        for r in sums.collect() for j in range(8)
    }
    assert got == wanted


def test_sanity_flags(frame):
    fresh = frame([("a", 0.8, 0.5), ("b", 0.8, 0.5), ("c", 0.8, 0.5)], "target string, auc double, f1 double")
    stored = frame([("a", 0.805, 0.5), ("b", 0.85, None)], "target string, auc double, f1 double")
    got = {r["target"]: r["sanity_flag"] for r in metrics.metric_sanity(fresh, stored).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}


def test_summary_and_comparison(spark):
    rows = random_rows(6, 100)
    df = make(spark, rows).withColumn("target", F.lit("t")).withColumn("q", 1 - F.col("p"))
    thr = spark.createDataFrame([("t", 0.4)], "target string, threshold double")
    row = metrics.summary(df, thr).first()
    assert row["auc"] == pytest.approx(brute_auc(rows)) and row["threshold"] == 0.4
    both = metrics.compare_models(df, ["p", "q"]).first()
    assert both["p_auc"] == pytest.approx(1 - both["q_auc"])


def test_invalid_scores_follow_one_rule(frame):
    df = frame(
        [(1, 0.9), (0, 0.1), (1, float("nan")), (0, None), (None, 0.5)], "y int, p double"
    )
    row = metrics.invalid_scores(df).first()
    assert (row["n_rows"], row["n_invalid"]) == (5, 3)
    assert metrics.score_metrics(df).first()["n"] == 2
    found = metrics.confusion(df, 0.5).first()
    assert [found[c] for c in ("tp", "fp", "fn", "tn")] == [1, 0, 0, 1]
    assert metrics.brier(df).first()["brier"] == pytest.approx(0.01)
    assert metrics.reliability(df, 2).agg({"n": "sum"}).first()[0] == 2


def test_digits_keep_the_order_and_bound_every_group(spark):
    """A million values between 1e9 and 1e9 + 1 share all leading bits."""
    narrow = spark.range(1_000_000).select((F.lit(1e9) + F.col("id") / 1e6).alias("v")).distinct()
    placed = ranking.with_digits(narrow, "v")
    for level in range(len(ranking.DIGITS)):
        child = ranking.DIGITS[level + 1] if level + 1 < len(ranking.DIGITS) else "v"
        sizes = placed.groupBy(*ranking.DIGITS[: level + 1]).agg(F.count_distinct(child).alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 65_537
    rng = random.Random(7)
    values = {0.0, 1.0, 2.0, 4.0, 1000.0, 8.0, 5e-324, 1e-310, 1.7e308, float("inf")}
    values |= {rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)}
    values |= {2.0**k for k in range(-60, 60)} | {math.nextafter(2.0**k, 0) for k in range(-60, 60)}
    values |= {-v for v in values}
    rows = ranking.with_digits(
        spark.createDataFrame([(v,) for v in values], "v double"), "v"
    ).collect()
    rows.sort(key=lambda r: r["v"])
    keys = [tuple(r[d] for d in ranking.DIGITS) for r in rows]
    assert keys == sorted(keys)
