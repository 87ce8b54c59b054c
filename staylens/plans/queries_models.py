"""Queries: model fits, calibration, importances and scoring.

Fits are not expressible in SQL, so most of these carry no oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import explain, metrics, models, sampling, vectors
from staylens.plans import bindings as b
from staylens.plans import build
from staylens.plans.registry import query
from staylens.session import scratch, settle
from staylens.sources import bundles

FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "distinct_share"]
TREES = {"maxIter": 10, "maxDepth": 3}
SEED = 42
TARGETS = ("quality", "toxic")


def document_features(spark, d):
    """Labelled documents with simple whole-text features, read off after the label join."""
    text = F.col("text")
    words = F.split(F.lower(text), r"\s+")
    size = F.greatest(F.length(text), F.lit(1))
    docs = b.table(spark, d, "documents").select("doc_id", "n_chars", "text")
    labels = b.table(spark, d, "labels")
    others = [F.col(c) for c in labels.columns if c != "doc_id"]
    # whole runs are cut out at once: one match a run, not one a letter
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("entity_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace(text, "[^0-9]+", "")) / size).alias("digit_share"),
        (F.length(F.regexp_replace(text, "[^A-Z]+", "")) / size).alias("upper_share"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        *others,
    )


def document_rows(spark, d):
    """Features of the labelled documents with a shared split."""
    rows = document_features(spark, d)
    return settle(sampling.stratified_split(rows, "entity_id", "quality", seed=SEED))


def _split(rows, name):
    return rows.filter(F.col("split") == name)


@query("fit_logistic_baseline")
def fit_logistic_baseline(spark, d):
    """Validation AUC of the baseline per target."""
    rows = document_rows(spark, d)
    out = None
    for target in TARGETS:
        fitted = models.baseline_logistic(_split(rows, "train"), FEATURES, target)
        scored = models.predict(fitted, _split(rows, "val"))
        auc = metrics.roc_auc(scored, target).select(
            F.lit(target).alias("target"), F.col("auc").alias("baseline_val_auc")
        )
        out = auc if out is None else out.unionByName(auc)
    return out


@query("fit_gbt")
def fit_gbt(spark, d):
    """Test metrics of the calibrated train-only model and the full model, both targets."""
    rows = document_rows(spark, d)
    out = None
    for target in TARGETS:
        fitted = models.fit_target(rows, FEATURES, TREES, target, True, SEED)
        test = models.predict(fitted.base, _split(rows, "test"), "base_raw")
        test = models.calibrate(test, fitted.calibrator, "base_raw", "base_cal")
        test = models.predict(fitted.full, test, "full_raw")
        scored = test.select(
            F.lit(target).alias("target"), F.col(target).alias("y"), "base_raw", "base_cal", "full_raw"
        )
        out = scored if out is None else out.unionByName(scored)
    return metrics.compare_models(settle(out), ["full_raw", "base_raw", "base_cal"])


@query("cv_tune")
def cv_tune(spark, d):
    """Mean fold AUC of drawn parameter sets under successive halving."""
    rows = _split(document_rows(spark, d), "train")
    trials = models.draw_params(3, SEED, {**models.SEARCH_RANGES, "maxIter": (5, 10, "int")})
    return models.tune(rows, FEATURES, trials, 5, "quality", seed=SEED, rungs=(0.4, 1.0)).scores


@query(
    "cv_folds",
    f"""WITH t AS (SELECT *, 'quality' AS target, quality AS y FROM labels UNION ALL SELECT *, 'toxic', toxic FROM labels),
r AS (SELECT target, y, row_number() OVER (PARTITION BY target, y ORDER BY {b.hash_sql("doc_id", 42)}, doc_id) - 1 AS rk,
             count(*) OVER (PARTITION BY target, y) AS n FROM t),
f AS (SELECT target, y, (SELECT count(*) FROM range(1, 5) k(i) WHERE rk >= (n * i + 4) // 5) AS fold FROM r)
SELECT target, fold::INT AS fold, count(*) AS n, sum(y)::BIGINT AS n_pos FROM f GROUP BY target, fold""",
)
def cv_folds(spark, d):
    """Sizes and class balance of the five tuning folds of both targets."""
    labels = b.table(spark, d, "labels")
    out = None
    for target in TARGETS:
        folds = sampling.stratified_folds(labels, "doc_id", target, 5, SEED)
        sizes = folds.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("n_pos")
        ).select(F.lit(target).alias("target"), F.col("fold").cast("int").alias("fold"), "n", "n_pos")
        out = sizes if out is None else out.unionByName(sizes)
    return out


ISOTONIC = f"""WITH {b.SCORED_SQL},
g AS (SELECT target, p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY target ORDER BY p) AS i
      FROM scored GROUP BY target, p),
c AS (SELECT target, i, p, sum(s) OVER (PARTITION BY target ORDER BY i) AS cs,
             sum(n) OVER (PARTITION BY target ORDER BY i) AS cn, s, n FROM g),
m AS (SELECT a.target, a.i AS a, z.i AS z, (z.cs - a.cs + a.s) / (z.cn - a.cn + a.n) AS v
      FROM c a JOIN c z ON z.target = a.target AND z.i >= a.i),
lo AS (SELECT target, a, z, min(v) OVER (PARTITION BY target, a ORDER BY z DESC) AS v FROM m),
f AS (SELECT target, z AS i, max(v) AS p_cal FROM lo GROUP BY target, z)
SELECT x.target, x.entity_id, x.y, round(x.p, 9) AS p, round(f.p_cal, 6) AS p_cal
FROM scored x JOIN g USING (target, p) JOIN f USING (target, i)"""


@query("isotonic_scores", ISOTONIC)
def isotonic_scores(spark, d):
    """Every scored document of both targets with its isotonic calibration."""
    rows = b.scored(spark, d)
    steps = models.fit_calibrator(rows, "p", "y", ["target"])
    out = models.calibrate(rows.select("target", "entity_id", "y", "p"), steps, "p", "p_cal", ["target"])
    return out.select("target", "entity_id", "y", *b.ends(("p", 9), ("p_cal", 6)))


@query("stored_calibration", ISOTONIC)
def stored_calibration(spark, d):
    """The calibrated scores again, by a bundle that was saved and loaded."""
    rows = b.scored(spark, d)
    fitted = {
        t: models.TargetModel(None, None, models.fit_calibrator(rows.filter(F.col("target") == t), "p", "y"), 0.5)
        for t in TARGETS
    }
    schema = spark.createDataFrame([("p", 0, 0.0)], "feature string, ordinal int, median double")
    path = scratch(spark)
    bundles.save(path, fitted, schema)
    out = None
    for target, model in bundles.load(spark, path, expected=schema).models.items():
        some = rows.filter(F.col("target") == target).select("target", "entity_id", "y", "p")
        some = models.calibrate(some, model.calibrator, "p", "p_cal")
        out = some if out is None else out.unionByName(some)
    return out.select("target", "entity_id", "y", *b.ends(("p", 9), ("p_cal", 6)))


def _trees(spark, d):
    rows = document_rows(spark, d)
    return rows, models.boosted_trees(_split(rows, "train"), FEATURES, TREES, "quality", SEED)


@query("gain_importance")
def gain_importance(spark, d):
    """Native importance of the tree model."""
    _, fitted = _trees(spark, d)
    return models.gain_importance(fitted, FEATURES, spark)


@query("permutation_importance")
def permutation_importance(spark, d):
    """AUC lost per shuffled feature on the test split."""
    rows, fitted = _trees(spark, d)
    test = _split(rows, "test").withColumnRenamed("quality", "y")
    return explain.permutation_importance(
        test, FEATURES, lambda df: models.predict(fitted, df), seed=SEED
    )


LINEAR = {"size": 1.0, "rest": 3.0, "part": 50.0}


@query(
    "permutation_linear",
    f"""WITH l AS (
  SELECT l.doc_id, t.target, CASE WHEN t.target = 'quality' THEN l.quality ELSE l.toxic END AS y,
         d.n_chars::DOUBLE AS size, (d.n_chars % 997)::DOUBLE AS rest, (l.doc_id % 101)::DOUBLE AS part
  FROM labels l JOIN documents d USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic')) t(target)),
a AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {b.hash_sql("doc_id", 42)}, doc_id) AS slot,
             row_number() OVER (PARTITION BY target ORDER BY {b.hash_sql("doc_id", 43)}, doc_id) AS gives FROM l),
m AS (SELECT a.target, f.feature, a.y,
             CASE f.feature WHEN 'size' THEN z.size ELSE a.size END
             + 3 * CASE f.feature WHEN 'rest' THEN z.rest ELSE a.rest END
             + 50 * CASE f.feature WHEN 'part' THEN z.part ELSE a.part END AS p
      FROM a JOIN a z ON z.target = a.target AND z.gives = a.slot
      CROSS JOIN (VALUES ('size'), ('rest'), ('part'), ('')) f(feature)),
k AS (SELECT *, rank() OVER (PARTITION BY target, feature ORDER BY p)
             + (count(*) OVER (PARTITION BY target, feature, p) - 1) / 2.0::DOUBLE AS rk FROM m),
g AS (SELECT target, feature, sum(y)::DOUBLE AS np, (count(*) - sum(y))::DOUBLE AS nn,
             sum(rk) FILTER (WHERE y = 1) AS s FROM k GROUP BY target, feature),
u AS (SELECT target, feature, (s - np * (np + 1) / 2) / (np * nn) AS auc FROM g)
SELECT x.target, x.feature, round(w.auc, 6) AS base_auc, round(x.auc, 6) AS shuffled_auc,
       round(w.auc - x.auc, 6) AS importance
FROM u x JOIN u w ON w.target = x.target AND w.feature = '' WHERE x.feature <> ''""",
)
def permutation_linear(spark, d):
    """AUC lost per shuffled feature of a fixed linear score, both targets."""
    docs = b.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = settle(
        b.table(spark, d, "labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("entity_id"), "quality", "toxic",
            F.col("n_chars").cast("double").alias("size"),
            (F.col("n_chars") % 997).cast("double").alias("rest"),
            (F.col("doc_id") % 101).cast("double").alias("part"),
        )
    )
    p = sum(F.col(f) * w for f, w in LINEAR.items())
    out = None
    for target in TARGETS:
        lost = explain.permutation_importance(
            rows, list(LINEAR), lambda df: df.withColumn("p", p), y=target, seed=SEED
        )
        lost = lost.select(
            F.lit(target).alias("target"), "feature",
            *b.ends(("base_auc", 6), ("shuffled_auc", 6), ("importance", 6)),
        )
        out = lost if out is None else out.unionByName(lost)
    return out


@query("logistic_contributions")
def logistic_contributions(spark, d):
    """Mean absolute contribution of every feature to the baseline of each target."""
    rows = document_rows(spark, d)
    cells = rows.unpivot(["entity_id"], FEATURES, "feature", "value")
    total = rows.agg(F.count(F.lit(1))).scalar()
    out = None
    for target in TARGETS:
        fitted = models.baseline_logistic(_split(rows, "train"), FEATURES, target)
        weights = models.logistic_weights(fitted, FEATURES, spark)
        parts = vectors.mean_abs_contribution(vectors.linear_contributions(cells, weights, total))
        parts = parts.select(F.lit(target).alias("target"), "feature", "mean_abs_contribution")
        out = parts if out is None else out.unionByName(parts)
    return out


def surrogate_sources(spark, d) -> build.Sources:
    """Sources of the end-to-end build, all taken from orders, lines and parts."""
    base = b.stays(spark, d)
    first = b.first_stays(spark, d, base)
    lines = b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("item_label"),
        F.col("l_shipdate").alias("t"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("event_id"),
    )
    # every slice of every build starts from lines of index stays: found in one scan for all
    lines = settle(lines.join(first.select("stay_id"), "stay_id", "left_semi"))
    parts = b.items(spark, d)
    named = parts.select("item_id", F.col("label").alias("item_label"))
    drugs = lines.join(parts.select("item_id", "drug"), "item_id")
    return build.Sources(
        stays=base,
        entities=b.entities(spark, d, first),
        vitals=lines.drop("value").withColumnRenamed("quantity", "value"),
        labs=lines.drop("item_label", "quantity"),
        rx=drugs.drop("item_label"),
        proc=lines.select("stay_id", "item_id", "item_label", "t"),
        lab_items=named,
    )


def surrogate_config() -> build.Config:
    return build.Config(
        window_hours=b.LAB_HOURS,
        prolonged_days=b.PROLONGED_DAYS,
        category_rules=b.SEGMENT_RULES,
        drug_patterns=b.ITEM_PATTERNS,
        procedure_patterns={"proc_returned_any": ["r"], "proc_accepted_any": ["a"]},
    )


@query(
    "training_build",
    f"""{b.COHORT_SQL},
w AS (SELECT i.entity_id FROM lineitem l JOIN idx i ON i.stay_id = l.l_orderkey
      WHERE date_diff('hour', i.admit, l.l_shipdate) BETWEEN 0 AND 8760
        AND i.entity_id IN (SELECT entity_id FROM label_table))
SELECT 'index' AS modality, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM idx
UNION ALL SELECT 'labelled', count(*), count(DISTINCT entity_id) FROM label_table
UNION ALL SELECT m, count(*), count(DISTINCT entity_id) FROM w, (VALUES ('vitals'), ('labs'), ('rx'), ('proc')) t(m) GROUP BY m""",
)
def training_build(spark, d):
    """Rows and entities per step of the training-side build."""
    return build.build_training(surrogate_sources(spark, d), None, surrogate_config()).counts


@query("score_unseen")
def score_unseen(spark, d):
    """Train on the cohort, then score every customer."""
    sources, config = surrogate_sources(spark, d), surrogate_config()
    training = build.build_training(sources, None, config)
    rows, schema = build.training_vectors(training, config.seed)
    params = {t: TREES for t in build.TARGETS}
    fitted = build.fit_all(settle(rows), params=params, seed=config.seed)
    everyone = sources.entities.select("entity_id")
    return build.score_unseen(sources, everyone, fitted, schema, config)
