"""Queries: subgroup audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import times
from staylens.operators import fairness, sampling
from staylens.plans import bindings as b
from staylens.plans.queries_metrics import AP_SQL, AUC_SQL
from staylens.plans.queries_sampling import _SPLIT as SPLIT_SQL
from staylens.plans.registry import query

THRESHOLD = 0.5
EDGES = [0, 500, 1000, 2000, 5000, 1000000000]
BANDS = ["0-500", "500-1000", "1000-2000", "2000-5000", "5000+"]
_BAND_SQL = """CASE WHEN n_chars < 500 THEN '0-500' WHEN n_chars < 1000 THEN '500-1000'
  WHEN n_chars < 2000 THEN '1000-2000' WHEN n_chars < 5000 THEN '2000-5000' ELSE '5000+' END"""

SQL = f"""WITH {b.SCORED_SQL},
x AS (
  SELECT target, 'lang' AS group_category, lang AS group_value, p, y FROM scored
  UNION ALL SELECT target, 'source', source, p, y FROM scored
  UNION ALL SELECT target, 'age_band', {_BAND_SQL}, p, y FROM scored
  UNION ALL SELECT target, 'all', 'all', p, y FROM scored),
h AS (SELECT target, group_category, group_value, p, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM x GROUP BY ALL),
k AS (
  SELECT *, sum(pos) OVER w::DOUBLE AS tp, sum(neg) OVER w::DOUBLE AS fp,
         sum(pos) OVER v::DOUBLE AS np, sum(neg) OVER v::DOUBLE AS nn FROM h
  WINDOW w AS (PARTITION BY target, group_category, group_value ORDER BY p DESC),
         v AS (PARTITION BY target, group_category, group_value)),
a AS (SELECT target, group_category, group_value, CASE WHEN max(np) * max(nn) > 0 THEN {AUC_SQL} END AS auc,
             CASE WHEN max(np) > 0 THEN {AP_SQL} END AS pr_auc FROM k GROUP BY ALL),
c AS (SELECT target, group_category, group_value, count(*) AS n, avg(y) AS prevalence, avg((p - y) * (p - y)) AS brier,
             count(*) FILTER (WHERE p >= {THRESHOLD} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {THRESHOLD} AND y = 0) AS fp,
             count(*) FILTER (WHERE p < {THRESHOLD} AND y = 1) AS fn FROM x GROUP BY ALL),
m AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f0 FROM c JOIN a USING (target, group_category, group_value)),
g AS (SELECT target, auc AS global_auc, f0 AS global_f1, n AS cohort_n FROM m WHERE group_category = 'all'),
f AS (
  SELECT m.target, 'score' AS prob_source, group_category, group_value, n, prevalence, auc, pr_auc, brier,
    {THRESHOLD}::DOUBLE AS threshold, CASE WHEN tp + fn > 0 THEN f0 END AS f1,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, global_auc, global_f1,
    auc - global_auc AS delta_auc, CASE WHEN tp + fn > 0 THEN f0 END - global_f1 AS delta_f1,
    cohort_n, (n < {fairness.SMALL_GROUP})::INT AS small
  FROM m JOIN g USING (target) WHERE group_category <> 'all')"""
FIGURES = ("prevalence", "auc", "pr_auc", "brier", "f1", "precision", "recall",
           "global_auc", "global_f1", "delta_auc", "delta_f1")


def _metrics(spark, d):
    rows = b.scored(spark, d).withColumn("threshold", F.lit(THRESHOLD))
    groups = {
        "lang": F.col("lang"),
        "source": F.col("source"),
        "age_band": times.band(F.col("n_chars"), EDGES, BANDS),
    }
    return fairness.group_metrics(rows, groups)


def _shown(df):
    names = [c for c in df.columns if c not in FIGURES]
    return df.select(*names, *b.ends(*[(c, 6) for c in FIGURES]))


@query(
    "fairness_groups",
    f"""{SQL} SELECT target, prob_source, group_category, group_value, n, cohort_n, small, threshold,
  {", ".join(f"round({c}, 6) AS {c}" for c in FIGURES)} FROM f""",
)
def fairness_groups(spark, d):
    return _shown(_metrics(spark, d).withColumn("small", F.col("small").cast("int")))


# The same table over the test split of the labels.
_TEST = SPLIT_SQL.replace("h AS (", "hashed AS (", 1).replace("FROM h)", "FROM hashed)", 1)
TEST_SQL = f"{_TEST}, {SQL.removeprefix('WITH ').strip()}".replace(
    "FROM labels l", "FROM (SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM s WHERE split = 'test')) l", 1
)


@query(
    "fairness_table",
    f"""{TEST_SQL} SELECT target, prob_source, group_category, group_value, n, cohort_n, small, threshold,
  {", ".join(f"round({c}, 6) AS {c}" for c in FIGURES)} FROM f""",
)
def fairness_table(spark, d):
    """The audit in one call, on the test split."""
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = b.table(spark, d, "labels")
    test = sampling.stratified_split(labels, "doc_id", "quality", seed=42).filter("split = 'test'")
    rows = labels.join(docs, "doc_id").withColumnRenamed("doc_id", "entity_id")
    rows = rows.withColumn("p", F.col("n_chars") / (F.col("n_chars") + 1500.0))
    out = fairness.fairness_table(
        rows,
        {"quality": ("quality", "p"), "toxic": ("toxic", "p")},
        {"quality": THRESHOLD, "toxic": THRESHOLD},
        {"lang": F.col("lang"), "source": F.col("source"), "age_band": times.band(F.col("n_chars"), EDGES, BANDS)},
        test.withColumnRenamed("doc_id", "entity_id"),
    )
    return _shown(out.withColumn("small", F.col("small").cast("int")))


@query(
    "fairness_support",
    f"""{SQL}, s AS (SELECT group_category, group_value, max(n) AS n FROM f GROUP BY ALL)
SELECT group_category, group_value, n, round(n * 100 / (SELECT max(cohort_n) FROM f)::DOUBLE, 2) AS pct FROM s""",
)
def fairness_support(spark, d):
    return fairness.support(_metrics(spark, d))


@query(
    "fairness_overview",
    f"""{SQL} SELECT target, group_category, count(DISTINCT group_value) AS groups, min(n) AS min_n, max(n) AS max_n,
  round(avg(delta_auc), 6) AS mean_delta_auc, round(avg(delta_f1), 6) AS mean_delta_f1 FROM f GROUP BY target, group_category""",
)
def fairness_overview(spark, d):
    out = fairness.overview(_metrics(spark, d))
    return out.withColumn("mean_delta_auc", F.round("mean_delta_auc", 6)).withColumn(
        "mean_delta_f1", F.round("mean_delta_f1", 6)
    )


@query(
    "fairness_flags",
    f"""{SQL} SELECT target, group_category, group_value, n, round(delta_auc, 6) AS delta_auc, round(delta_f1, 6) AS delta_f1
FROM f WHERE coalesce(abs(delta_auc) > 0.05, FALSE) OR coalesce(abs(delta_f1) > 0.05, FALSE)""",
)
def fairness_flags(spark, d):
    out = fairness.flags(_metrics(spark, d))
    return out.select(
        "target", "group_category", "group_value", "n", *b.ends(("delta_auc", 6), ("delta_f1", 6))
    )


@query(
    "fairness_matrix",
    f"""{SQL} SELECT group_category, group_value, round(max(auc) FILTER (WHERE target = 'quality'), 6) AS quality,
  round(max(auc) FILTER (WHERE target = 'toxic'), 6) AS toxic FROM f GROUP BY group_category, group_value""",
)
def fairness_matrix(spark, d):
    out = fairness.matrix(_metrics(spark, d), ["quality", "toxic"])
    return out.select("group_category", "group_value", *b.ends(("quality", 6), ("toxic", 6)))


@query(
    "prevalence_relation",
    f"""{SQL} SELECT target, group_category, group_value, n, round(prevalence, 6) AS prevalence, round(auc, 6) AS auc FROM f""",
)
def prevalence_relation(spark, d):
    out = fairness.ordered(fairness.prevalence_relation(_metrics(spark, d)))
    return out.select(
        "target", "group_category", "group_value", "n", *b.ends(("prevalence", 6), ("auc", 6))
    )
