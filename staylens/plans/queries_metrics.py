"""Queries: ranking, calibration, threshold and bootstrap metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import metrics, ranking, sampling
from staylens.plans import bindings as b
from staylens.plans.registry import query

THRESHOLD = 0.5
N_BOOT = 2000

# Distinct scores with the counts at or above each one.
RANKED = f"""WITH {b.SCORED_SQL},
h AS (SELECT target, p, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM scored GROUP BY target, p),
k AS (
  SELECT *, sum(pos) OVER (PARTITION BY target ORDER BY p DESC)::DOUBLE AS tp,
         sum(neg) OVER (PARTITION BY target ORDER BY p DESC)::DOUBLE AS fp,
         sum(pos) OVER (PARTITION BY target)::DOUBLE AS np,
         sum(neg) OVER (PARTITION BY target)::DOUBLE AS nn FROM h)"""
AUC_SQL = "sum(pos * (nn - fp + neg / 2.0::DOUBLE)) / (max(np) * max(nn))"
AP_SQL = "sum(pos * tp / (tp + fp)) / max(np)"
PRT_SQL = """sum(pos * (tp / (tp + fp) + CASE WHEN tp + fp - pos - neg > 0
  THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2.0::DOUBLE) / max(np)"""


def _one(name, sql, build, column):
    def run(spark, d):
        out = build(b.scored(spark, d), keys=["target"])
        return out.select("target", F.round(column, 6).alias(column))

    query(name, f"{RANKED} SELECT target, round({sql}, 6) AS {column} FROM k GROUP BY target")(run)


_one("roc_auc", AUC_SQL, metrics.roc_auc, "auc")
_one("avg_precision", AP_SQL, metrics.average_precision, "pr_auc")
_one("pr_auc_trapezoid", PRT_SQL, metrics.pr_auc_trapezoid, "pr_auc_trapezoid")


@query(
    "brier",
    f"WITH {b.SCORED_SQL} SELECT target, round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY target",
)
def brier(spark, d):
    return metrics.brier(b.scored(spark, d), keys=["target"]).select("target", *b.ends(("brier", 6)))


@query(
    "roc_curve",
    f"""{RANKED}
SELECT target, round(p, 9) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM k
UNION ALL SELECT DISTINCT target, NULL, 0.0, 0.0 FROM k""",
)
def roc_curve(spark, d):
    out = metrics.roc_curve(b.scored(spark, d), keys=["target"])
    return out.select("target", *b.ends(("threshold", 9), ("fpr", 6), ("tpr", 6)))


@query(
    "pr_curve",
    f"""{RANKED}
SELECT target, round(p, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM k
UNION ALL SELECT DISTINCT target, NULL, 1.0, 0.0 FROM k""",
)
def pr_curve(spark, d):
    out = metrics.pr_curve(b.scored(spark, d), keys=["target"])
    return out.select("target", *b.ends(("threshold", 9), ("precision", 6), ("recall", 6)))


@query(
    "reliability_15q",
    f"""WITH {b.SCORED_SQL},
r AS (SELECT target, p, row_number() OVER (PARTITION BY target ORDER BY p) - 1 AS rk,
             count(*) OVER (PARTITION BY target) AS n FROM scored),
q AS (SELECT DISTINCT target, n, i, (i / 15.0::DOUBLE) * (n - 1) AS pos FROM r, range(1, 15) t(i)),
e AS (SELECT q.target, q.i, lo.p AS a, hi.p AS z, pos - floor(pos) AS f FROM q
      JOIN r lo ON lo.target = q.target AND lo.rk = floor(pos)
      JOIN r hi ON hi.target = q.target AND hi.rk = ceil(pos)),
v AS (SELECT target, i, CASE WHEN f < 0.5 THEN a + (z - a) * f ELSE z - (z - a) * (1 - f) END AS edge FROM e),
b AS (SELECT s.target, s.p, s.y, (SELECT count(*) FROM v WHERE v.target = s.target AND v.edge < s.p) AS bin FROM scored s)
SELECT target, bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate
FROM b GROUP BY target, bin""",
)
def reliability_15q(spark, d):
    out = metrics.reliability(b.scored(spark, d), 15, keys=["target"])
    return out.select(
        "target", F.col("bin").cast("long").alias("bin"), "n",
        *b.ends(("mean_predicted", 6), ("observed_rate", 6)),
    )


@query(
    "exact_quantiles",
    """WITH r AS (SELECT source, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS rk,
                  count(*) OVER (PARTITION BY source) AS n FROM documents),
q AS (SELECT DISTINCT source, o, pr, pr * (n - 1) AS pos FROM r, (VALUES (0, 0.025::DOUBLE), (1, 0.5), (2, 0.975)) t(o, pr))
SELECT q.source, o::INT AS ordinal, pr AS prob, round(CASE WHEN pos - floor(pos) < 0.5
  THEN lo.v + (hi.v - lo.v) * (pos - floor(pos)) ELSE hi.v - (hi.v - lo.v) * (1 - (pos - floor(pos))) END, 6) AS value
FROM q JOIN r lo ON lo.source = q.source AND lo.rk = floor(pos) JOIN r hi ON hi.source = q.source AND hi.rk = ceil(pos)""",
)
def exact_quantiles(spark, d):
    docs = b.table(spark, d, "documents").select("source", "n_chars")
    out = ranking.exact_quantiles(docs, "n_chars", [0.025, 0.5, 0.975], ["source"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "calibration_shift",
    f"WITH {b.SCORED_SQL} SELECT target, round(avg(abs(p - p2)), 6) AS mean_abs_shift FROM scored GROUP BY target",
)
def calibration_shift(spark, d):
    out = metrics.calibration_shift(b.scored(spark, d), "p", "p2", ["target"])
    return out.select("target", *b.ends(("mean_abs_shift", 6)))


@query(
    "score_histogram",
    f"""WITH {b.SCORED_SQL}, t AS (SELECT 'p' AS "column", p FROM scored UNION ALL SELECT 'p2', p2 FROM scored),
g AS (SELECT c AS "column", i::BIGINT AS bin FROM (VALUES ('p'), ('p2')) x(c), range(0, 10) r(i))
SELECT g."column", g.bin, count(t.p) AS n FROM g LEFT JOIN t
  ON t."column" = g."column" AND least(floor(t.p * 10), 9)::BIGINT = g.bin GROUP BY g."column", g.bin""",
)
def score_histogram(spark, d):
    return metrics.score_histogram(b.scored(spark, d), ["p", "p2"])


_CONFUSION = f"""WITH {b.SCORED_SQL},
c AS (SELECT target, count(*) FILTER (WHERE p >= {THRESHOLD} AND y = 1) AS tp,
             count(*) FILTER (WHERE p >= {THRESHOLD} AND y = 0) AS fp,
             count(*) FILTER (WHERE p < {THRESHOLD} AND y = 1) AS fn,
             count(*) FILTER (WHERE p < {THRESHOLD} AND y = 0) AS tn FROM scored GROUP BY target),
m AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS pr, tp / (tp + fn + 1e-9::DOUBLE) AS rc FROM c)"""


@query(
    "confusion_at",
    f"""{_CONFUSION} SELECT target, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(2 * pr * rc / (pr + rc + 1e-9::DOUBLE), 6) AS f1 FROM m""",
)
def confusion_at(spark, d):
    out = metrics.confusion(b.scored(spark, d), THRESHOLD, keys=["target"])
    return out.select(
        "target", "tp", "fp", "fn", "tn", *b.ends(("precision", 6), ("recall", 6), ("f1", 6))
    )


@query(
    "confusion_zero_safe",
    f"""WITH {b.SCORED_SQL},
c AS (SELECT source, target, count(*) FILTER (WHERE p >= 0.9 AND y = 1) AS tp,
             count(*) FILTER (WHERE p >= 0.9 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.9 AND y = 1) AS fn FROM scored GROUP BY source, target)
SELECT source, target, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c""",
)
def confusion_zero_safe(spark, d):
    keys = ["source", "target"]
    out = metrics.confusion(b.scored(spark, d), 0.9, keys=keys, zero_division="zero")
    return out.select(*keys, *b.ends(("precision", 6), ("recall", 6), ("f1", 6)))


@query(
    "cost_fbeta",
    f"""{_CONFUSION} SELECT target, 1.0::DOUBLE * fp + 5.0::DOUBLE * fn AS cost,
       round(5 * pr * rc / (4 * pr + rc + 1e-9::DOUBLE), 6) AS fbeta FROM m""",
)
def cost_fbeta(spark, d):
    out = metrics.cost_fbeta(metrics.confusion(b.scored(spark, d), THRESHOLD, keys=["target"]))
    return out.select("target", "cost", *b.ends(("fbeta", 6)))


def _sweep_sql(low, high, n, eps):
    ratio = (
        "tp / (tp + {x} + 1e-9::DOUBLE)" if eps
        else "CASE WHEN tp + {x} > 0 THEN tp / (tp + {x})::DOUBLE ELSE 0 END"
    )
    f1 = (
        "2 * pr * rc / (pr + rc + 1e-9::DOUBLE)" if eps
        else "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END"
    )
    step = (high - low) / (n - 1)
    return f"""WITH {b.SCORED_SQL},
g AS (SELECT {low!r}::DOUBLE + i * {step!r}::DOUBLE AS thr FROM range(0, {n}) r(i)),
c AS (SELECT target, thr, count(*) FILTER (WHERE p >= thr AND y = 1) AS tp,
             count(*) FILTER (WHERE p >= thr AND y = 0) AS fp,
             count(*) FILTER (WHERE p < thr AND y = 1) AS fn FROM scored, g GROUP BY target, thr),
m AS (SELECT *, {ratio.format(x="fp")} AS pr, {ratio.format(x="fn")} AS rc FROM c),
f AS (SELECT *, {f1} AS f1 FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f1 DESC, thr) AS rn FROM f)"""


def _best(low, high, n, mode):
    def run(spark, d):
        out = metrics.best_threshold(
            b.scored(spark, d), low, high, n, keys=["target"], zero_division=mode
        )
        shown = (("threshold", 9), ("f1", 6), ("precision", 6), ("recall", 6))
        return out.select("target", *b.ends(*shown), "tp", "fp", "fn")

    return run


_BEST_SQL = """ SELECT target, round(thr, 9) AS threshold, round(f1, 6) AS f1, round(pr, 6) AS precision,
  round(rc, 6) AS recall, tp, fp, fn FROM r WHERE rn = 1"""
query("threshold_f1_300", _sweep_sql(0.01, 0.9, 300, True) + _BEST_SQL)(_best(0.01, 0.9, 300, "eps"))
query("threshold_f1_150", _sweep_sql(0.01, 0.99, 150, False) + _BEST_SQL)(
    _best(0.01, 0.99, 150, "zero")
)


@query(
    "threshold_sweep",
    _sweep_sql(0.01, 0.9, 300, True)
    + " SELECT target, round(thr, 9) AS threshold, tp, fp, fn, round(f1, 6) AS f1 FROM r",
)
def threshold_sweep(spark, d):
    out = metrics.threshold_sweep(b.scored(spark, d), keys=["target"])
    return out.select("target", *b.ends(("threshold", 9)), "tp", "fp", "fn", *b.ends(("f1", 6)))


_SUMMARY = f"""{RANKED},
a AS (SELECT target, {AUC_SQL} AS auc, {AP_SQL} AS pr_auc FROM k GROUP BY target),
br AS (SELECT target, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY target),
thr AS (SELECT * FROM (VALUES ('quality', 0.3::DOUBLE), ('toxic', 0.7::DOUBLE)) t(target, threshold)),
cf AS (SELECT target, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
             count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
             count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM scored JOIN thr USING (target) GROUP BY ALL),
m AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS pr, tp / (tp + fn + 1e-9::DOUBLE) AS rc FROM cf)"""


def _thresholds(df):
    limit = F.when(F.col("target") == "quality", 0.3).otherwise(0.7)
    return df.select("target").distinct().withColumn("threshold", limit)


def _summary(spark, d):
    rows = b.scored(spark, d)
    return metrics.summary(rows, _thresholds(rows))


@query(
    "metrics_summary",
    f"""{_SUMMARY}
SELECT target, round(auc, 6) AS auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, threshold,
       round(2 * pr * rc / (pr + rc + 1e-9::DOUBLE), 6) AS f1_at_threshold,
       round(pr, 6) AS precision_at_threshold, round(rc, 6) AS recall_at_threshold
FROM a JOIN br USING (target) JOIN m USING (target)""",
)
def metrics_summary(spark, d):
    shown = ("f1_at_threshold", "precision_at_threshold", "recall_at_threshold")
    return _summary(spark, d).select(
        "target", *b.ends(("auc", 6), ("pr_auc", 6), ("brier", 6)), "threshold",
        *b.ends(*[(c, 6) for c in shown]),
    )


_TWO = f"""WITH {b.SCORED_SQL},
t AS (SELECT target, 'p' AS model, p, y FROM scored UNION ALL SELECT target, 'p2', p2, y FROM scored),
h AS (SELECT target, model, p, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM t GROUP BY ALL),
k AS (
  SELECT *, sum(pos) OVER (PARTITION BY target, model ORDER BY p DESC)::DOUBLE AS tp,
         sum(neg) OVER (PARTITION BY target, model ORDER BY p DESC)::DOUBLE AS fp,
         sum(pos) OVER (PARTITION BY target, model)::DOUBLE AS np,
         sum(neg) OVER (PARTITION BY target, model)::DOUBLE AS nn FROM h),
a AS (SELECT target, model, {AUC_SQL} AS auc, {AP_SQL} AS pr_auc FROM k GROUP BY target, model),
br AS (SELECT target, model, avg((p - y) * (p - y)) AS brier FROM t GROUP BY target, model),
w AS (SELECT target, {", ".join(
    f"round(max({m}) FILTER (WHERE model = '{s}'), 6) AS {s}_{m}"
    for s in ("p", "p2") for m in ("auc", "pr_auc", "brier"))}
      FROM a JOIN br USING (target, model) GROUP BY target)"""


@query("model_comparison", f"{_TWO} SELECT * FROM w")
def model_comparison(spark, d):
    out = metrics.compare_models(b.scored(spark, d), ["p", "p2"])
    return out.select("target", *b.ends(*[(c, 6) for c in out.columns if c != "target"]))


@query(
    "summary_enriched",
    f"""{_TWO}, s AS (SELECT target, round(auc, 6) AS auc FROM a WHERE model = 'p')
SELECT s.target, s.auc, w.p2_auc, w.p2_brier FROM s LEFT JOIN w USING (target)""",
)
def summary_enriched(spark, d):
    left = _summary(spark, d).select("target", *b.ends(("auc", 6)))
    right = model_comparison(spark, d).select("target", "p2_auc", "p2_brier")
    return left.join(right, "target", "left")


@query(
    "metric_sanity",
    f"""{_TWO}, x AS (
  SELECT target, max(auc) FILTER (WHERE model = 'p') AS auc, max(auc) FILTER (WHERE model = 'p2') AS auc_stored,
         max(pr_auc) FILTER (WHERE model = 'p') AS pr_auc, max(pr_auc) FILTER (WHERE model = 'p2') AS pr_auc_stored
  FROM a GROUP BY target)
SELECT target, round(auc, 6) AS auc, round(auc_stored, 6) AS auc_stored, round(abs(auc - auc_stored), 6) AS delta_auc,
       round(abs(pr_auc - pr_auc_stored), 6) AS delta_pr_auc,
       (abs(auc - auc_stored) > 0.01 OR abs(pr_auc - pr_auc_stored) > 0.01)::INT AS sanity_flag FROM x""",
)
def metric_sanity(spark, d):
    rows = b.scored(spark, d)
    fresh = metrics.score_metrics(rows, keys=["target"])
    stored = metrics.score_metrics(rows, p="p2", keys=["target"])
    out = metrics.metric_sanity(fresh, stored, ("auc", "pr_auc"))
    shown = ("auc", "auc_stored", "delta_auc", "delta_pr_auc")
    return out.select("target", *b.ends(*[(c, 6) for c in shown]), "sanity_flag")


@query(
    "bootstrap_auc_diff",
    f"""WITH {b.SCORED_SQL},
x AS (SELECT target, y, p, p2, k.i AS blk, sha256(entity_id::VARCHAR || ':' || k.i::VARCHAR || ':42') AS dg
      FROM scored, range(0, {N_BOOT // sampling.REPLICATES}) k(i)),
s AS (SELECT target, y, p, p2, blk * {sampling.REPLICATES} + j.i AS rep, {sampling.weight_sql("substr(dg, 8 * j.i + 1, 8)")} AS wt
      FROM x, range(0, {sampling.REPLICATES}) j(i)),
t AS (SELECT target, rep, 'a' AS m, p AS v, y, wt FROM s UNION ALL SELECT target, rep, 'b', p2, y, wt FROM s
      UNION ALL SELECT target, -1, 'a', p, y, 1 FROM scored UNION ALL SELECT target, -1, 'b', p2, y, 1 FROM scored),
c AS (SELECT target, rep, m, v, sum(wt) FILTER (WHERE y = 1)::DOUBLE AS pos, sum(wt) FILTER (WHERE y = 0)::DOUBLE AS neg
      FROM t GROUP BY target, rep, m, v),
u AS (SELECT target, rep, m, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
             sum(coalesce(neg, 0)) OVER (PARTITION BY target, rep, m ORDER BY v) AS cum FROM c),
a AS (SELECT target, rep, m, CASE WHEN sum(pos) * sum(neg) > 0
             THEN sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)) END AS auc FROM u GROUP BY target, rep, m),
w AS (SELECT target, rep, max(auc) FILTER (WHERE m = 'a') AS auc_a, max(auc) FILTER (WHERE m = 'b') AS auc_b FROM a GROUP BY target, rep),
o AS (SELECT target, auc_a, auc_b, auc_a - auc_b AS diff FROM w WHERE rep = -1),
e AS (SELECT w.target, w.auc_a - w.auc_b AS bd, o.diff FROM w JOIN o USING (target) WHERE rep >= 0 AND w.auc_a - w.auc_b IS NOT NULL),
z AS (SELECT target, quantile_cont(bd, 0.025) AS lo, quantile_cont(bd, 0.975) AS hi, count(*) AS nb,
             count(*) FILTER (WHERE CASE WHEN diff >= 0 THEN bd <= 0 ELSE bd >= 0 END) AS op FROM e GROUP BY target)
SELECT target, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(diff, 6) AS diff_a_minus_b,
       round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper,
       round(least(1, 2 * (op + 1) / (nb + 1)::DOUBLE), 6) AS p_two_sided,
       (SELECT count(*) FROM labels) AS n_test, nb AS n_boot_effective
FROM o JOIN z USING (target)""",
)
def bootstrap_auc_diff(spark, d):
    out = metrics.bootstrap_auc_diff(b.scored(spark, d), "p", "p2", "entity_id", N_BOOT)
    shown = ("auc_a", "auc_b", "diff_a_minus_b", "ci_lower", "ci_upper", "p_two_sided")
    return out.select("target", *b.ends(*[(c, 6) for c in shown]), "n_test", "n_boot_effective")
