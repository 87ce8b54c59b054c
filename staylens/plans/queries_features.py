"""Queries: long and wide features, pruning, health and schema checks."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators import explain, features, prune, vectors
from staylens.plans import bindings as b
from staylens.plans.registry import query
from staylens.session import settle
from staylens.sources.files import schema_names

SQL = b.FEATURES_SQL
PROFILE = f"{SQL}, {b.PROFILE_SQL}"
# The wide schema of the test binding.
EVENT_LABELS = ("click", "error", "purchase", "signup", "view")
WIDE = [
    *[f"vitals:{label}__{s}" for label in EVENT_LABELS for s in ("mean", "count", "measured")],
    "labs:promo__mean", "labs:promo__measured", "rx_total_mentions", "admit_month",
]
ALIGNED = ["absent_one", *WIDE[:6], "admit_hour", "absent_two"]
MIN_SUPPORT = 10
TOP_K = 60


def _wide_sql(names, fill=None):
    cells = []
    for f in names:
        cell = f"max(value) FILTER (WHERE feature = '{f}')"
        if f.endswith("__measured"):
            seen = f"CASE WHEN bool_or(coalesce(modality = '{f.split(':')[0]}', FALSE)) THEN 0.0 END"
            cell = f"coalesce({cell}, {seen})"
        if fill is not None:
            cell = f"coalesce({cell}, {fill})"
        cells.append(f'round({cell}, 6) AS "{f}"')
    return f"SELECT entity_id, {', '.join(cells)} FROM long GROUP BY entity_id"


@query(
    "feature_long",
    f"{SQL} SELECT entity_id, modality, label, stat, feature, round(value, 6) AS value FROM long",
)
def feature_long(spark, d):
    return b.feature_long(spark, d).withColumn("value", F.round("value", 6))


@query("feature_wide", f"{SQL} {_wide_sql(WIDE)}")
def feature_wide(spark, d):
    wide = features.to_wide(b.feature_long(spark, d), WIDE)
    return wide.select("entity_id", *[F.round(F.col(text.quoted(c)), 6).alias(c) for c in WIDE])


@query("feature_align", f"{SQL} {_wide_sql(ALIGNED, 0.0)}")
def feature_align(spark, d):
    known = [c for c in ALIGNED if not c.startswith("absent")]
    wide = features.align(features.to_wide(b.feature_long(spark, d), known), ALIGNED)
    return wide.select("entity_id", *[F.round(F.col(text.quoted(c)), 6).alias(c) for c in ALIGNED])


def _profile(spark, d):
    long = b.settled_long(spark, d)
    return prune.feature_profile(long, prune.entity_count(long))


@query(
    "feature_support_variance",
    f"""{PROFILE}
SELECT feature, support, round(variance, 4) AS variance, round(min_value, 6) AS min_value,
       round(max_value, 6) AS max_value, is_variable::INT AS is_variable FROM profile""",
)
def feature_support_variance(spark, d):
    return _profile(spark, d).select(
        "feature", "support",
        *b.ends(("variance", 4), ("min_value", 6), ("max_value", 6)),
        F.col("is_variable").cast("int").alias("is_variable"),
    )


_KEPT_SQL = f"""{PROFILE},
ok AS (SELECT * FROM profile WHERE is_variable AND support >= {MIN_SUPPORT}),
z AS (
  SELECT feature, support, variance,
    0.7 * (variance - avg(variance) OVER ()) / (stddev_samp(variance) OVER () + 1e-12)
    + 0.3 * (support - avg(support) OVER ()) / (stddev_samp(support) OVER () + 1e-12) AS score
  FROM ok),
top AS (SELECT * FROM z ORDER BY score DESC, feature LIMIT {TOP_K}),
kept AS (SELECT row_number() OVER (ORDER BY feature) - 1 AS ordinal, * FROM top)"""


@query(
    "feature_prune",
    f"""{_KEPT_SQL}
SELECT feature, count(*) AS n, round(sum(value), 6) AS total
FROM long WHERE feature IN (SELECT feature FROM kept) GROUP BY feature""",
)
def feature_prune(spark, d):
    long = b.settled_long(spark, d)
    kept = prune.prune(long, prune.entity_count(long), MIN_SUPPORT, TOP_K)
    return kept.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


@query(
    "feature_topk_score",
    f"""{_KEPT_SQL}
SELECT ordinal, feature, support, round(variance, 4) AS variance, round(score, 6) AS score FROM kept""",
)
def feature_topk_score(spark, d):
    out = prune.kept_features(_profile(spark, d), MIN_SUPPORT, TOP_K)
    return out.select(
        F.col("ordinal").cast("long").alias("ordinal"), "feature", "support",
        *b.ends(("variance", 4), ("score", 6)),
    )


@query(
    "prune_report",
    f"""{PROFILE}
SELECT count(*) AS original, count(*) FILTER (WHERE NOT is_variable) AS zero_variance_dropped,
       count(*) FILTER (WHERE is_variable AND support < {MIN_SUPPORT}) AS low_support_dropped,
       count(*) FILTER (WHERE is_variable AND support >= {MIN_SUPPORT}) AS eligible FROM profile""",
)
def prune_report(spark, d):
    return prune.prune_report(_profile(spark, d), MIN_SUPPORT)


@query(
    "top_variance_preview",
    f"""{PROFILE}
SELECT feature, round(variance, 4) AS variance FROM profile ORDER BY profile.variance DESC, feature LIMIT 5""",
)
def top_variance_preview(spark, d):
    return prune.top_variance(_profile(spark, d)).select("feature", *b.ends(("variance", 4)))


@query(
    "support_quantiles",
    f"""{PROFILE}
SELECT count(*) AS n_features, round(avg(support), 6) AS mean_support,
       round(stddev_samp(support), 6) AS std_support, min(support) AS min_support,
       max(support) AS max_support,
       count(*) FILTER (WHERE support >= 1) AS n_at_least_1,
       count(*) FILTER (WHERE support >= 5) AS n_at_least_5,
       count(*) FILTER (WHERE support >= 10) AS n_at_least_10,
       round(quantile_cont(support::DOUBLE, 0.25), 6) AS q25,
       round(quantile_cont(support::DOUBLE, 0.5), 6) AS q50,
       round(quantile_cont(support::DOUBLE, 0.75), 6) AS q75 FROM profile""",
)
def support_quantiles(spark, d):
    out = prune.support_quantiles(_profile(spark, d))
    shown = [(c, 6) for c in ("mean_support", "std_support", "q25", "q50", "q75")]
    rest = [c for c in out.columns if c not in dict(shown)]
    return out.select(*rest, *b.ends(*shown))


@query(
    "feature_wide_pruned",
    f"""{_KEPT_SQL}
SELECT entity_id, feature, round(value, 6) AS value FROM filled WHERE feature IN (SELECT feature FROM kept)""",
)
def feature_wide_pruned(spark, d):
    """Cells of the wide form of pruned features, implied zeros included."""
    long = b.settled_long(spark, d)
    members = features.measured_members(long)
    schema = settle(prune.kept_features(
        prune.feature_profile(long, prune.entity_count(long)), MIN_SUPPORT, TOP_K
    ))
    names = schema_names(schema)
    kept = long.join(schema.select("feature"), "feature", "left_semi")
    wide = features.to_wide(kept, names, members=members)
    cells = wide.unpivot("entity_id", [F.col(text.quoted(n)) for n in names], "feature", "value")
    return cells.filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 6))


def _rounded(long):
    return long.withColumn("value", F.round("value", 6))


@query(
    "feature_health",
    f"""{PROFILE},
c AS (SELECT feature, entity_id, stat, round(value, 6) AS value FROM filled)
SELECT feature, min(value) AS min_value, max(value) AS max_value,
       round(stddev_pop(value), 4) AS std_pop, count(DISTINCT value) AS n_unique,
       round(1 - count(value) / (SELECT n FROM n_all)::DOUBLE, 6) AS missing_frac,
       (count(DISTINCT value) <= 1)::INT AS all_constant,
       sum({b.hash_sql("(entity_id::VARCHAR || ':' || value::DECIMAL(38, 6)::VARCHAR)", prune.HASH_SEED)})
         FILTER (WHERE stat IS NULL OR stat <> 'measured' OR value <> 0)::VARCHAR AS values_hash
FROM c GROUP BY feature""",
)
def feature_health(spark, d):
    """Values are rounded first: the last digits of means depend on summation order."""
    long = _rounded(b.settled_long(spark, d))
    out = prune.health_profile(long, prune.entity_count(long))
    return out.select(
        "feature", "min_value", "max_value", *b.ends(("std_pop", 4)), "n_unique",
        *b.ends(("missing_frac", 6)), "all_constant", "values_hash",
    )


@query(
    "feature_provenance",
    f"""{SQL}
SELECT DISTINCT feature, CASE WHEN feature LIKE '%\\_\\_measured' ESCAPE '\\' OR feature LIKE '%\\_\\_count' ESCAPE '\\'
       THEN 'missingness' ELSE 'baseline' END AS "group" FROM long
UNION ALL SELECT '__feature_schema_version__', '2025-missingness-v1'""",
)
def feature_provenance(spark, d):
    return features.provenance(b.feature_long(spark, d))


@query(
    "schema_jaccard",
    f"""{PROFILE},
a AS (SELECT DISTINCT feature FROM long), k AS (
  SELECT feature FROM profile WHERE is_variable AND support >= {MIN_SUPPORT} AND modality <> 'rx'
  UNION ALL SELECT 'made_up')
SELECT count(*) FILTER (WHERE a.feature IS NOT NULL AND k.feature IS NOT NULL) AS n_shared,
       count(*) AS n_union,
       count(*) FILTER (WHERE k.feature IS NULL) AS n_only_a,
       count(*) FILTER (WHERE a.feature IS NULL) AS n_only_b,
       round(count(*) FILTER (WHERE a.feature IS NOT NULL AND k.feature IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard
FROM a FULL JOIN k USING (feature)""",
)
def schema_jaccard(spark, d):
    profile = _profile(spark, d)
    kept = prune.kept_features(profile.filter(F.col("modality") != "rx"), MIN_SUPPORT, None)
    extra = spark.range(1).select(F.lit("made_up").alias("feature"))
    other = kept.select("feature").unionByName(extra)
    diff = prune.schema_diff(profile, other)
    return diff.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "variable_fraction",
    f"""{PROFILE}
SELECT count(*) AS n_features, count(*) FILTER (WHERE is_variable) AS n_variable,
       round(avg(is_variable::INT), 6) AS variable_fraction,
       count(*) FILTER (WHERE is_variable OR support < (SELECT n FROM n_all)) AS n_variable_null,
       round(avg((is_variable OR support < (SELECT n FROM n_all))::INT), 6) AS variable_fraction_null
FROM profile""",
)
def variable_fraction(spark, d):
    long = b.settled_long(spark, d)
    total = prune.entity_count(long)
    plain = prune.variable_fraction(long, total)
    strict = prune.variable_fraction(long, total, count_null=True).select(
        "n_features",
        F.col("n_variable").alias("n_variable_null"),
        F.round("variable_fraction", 6).alias("variable_fraction_null"),
    )
    return plain.withColumn("variable_fraction", F.round("variable_fraction", 6)).join(
        strict, "n_features"
    )


@query(
    "id_parity",
    f"""{b.COHORT_SQL}, {b.LABS_SQL},
f AS (SELECT DISTINCT entity_id FROM labs UNION SELECT DISTINCT user_id FROM events),
n AS (SELECT (SELECT count(*) FROM label_table) AS n_labels, (SELECT count(*) FROM f) AS n_features,
  (SELECT count(*) FROM label_table WHERE entity_id NOT IN (SELECT entity_id FROM f)) AS missing_in_features,
  (SELECT count(*) FROM f WHERE entity_id NOT IN (SELECT entity_id FROM label_table)) AS extra_in_features)
SELECT *, round((n_labels - missing_in_features) / n_labels::DOUBLE, 6) AS overlap_frac FROM n""",
)
def id_parity(spark, d):
    from staylens.plans.queries_cohort import _label_table

    have = b.labs(spark, d).select("entity_id").unionByName(
        b.user_events(spark, d).select("entity_id")
    )
    out = prune.id_parity(_label_table(spark, d), have)
    return out.withColumn("overlap_frac", F.round("overlap_frac", 6))


@query(
    "variance_collapse",
    f"""{PROFILE},
u AS (SELECT DISTINCT user_id AS entity_id FROM events),
x AS (SELECT feature, var_pop(value) AS v, min(value) < max(value) AS s FROM filled GROUP BY feature),
y AS (SELECT feature, var_pop(value) AS v, min(value) < max(value) AS s FROM filled
      WHERE entity_id IN (SELECT entity_id FROM u) GROUP BY feature)
SELECT x.feature, round(x.v, 3) AS var_before, round(y.v, 3) AS var_after,
       (x.s AND NOT coalesce(y.s, FALSE))::INT AS collapsed
FROM x LEFT JOIN y USING (feature)""",
)
def variance_collapse(spark, d):
    long = b.settled_long(spark, d)
    users = b.user_events(spark, d).select("entity_id").distinct()
    after = long.join(users, "entity_id", "left_semi")
    out = prune.variance_collapse(long, after)
    return out.select("feature", *b.ends(("var_before", 3), ("var_after", 3)), "collapsed")


@query(
    "modality_counts",
    f"""{SQL}
SELECT 'vitals' AS modality, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM vitals
UNION ALL SELECT 'labs', count(*), count(DISTINCT entity_id) FROM labs
UNION ALL SELECT 'index', count(*), count(DISTINCT entity_id) FROM idx""",
)
def modality_counts(spark, d):
    parts = {
        "vitals": b.vitals(spark, d),
        "labs": b.labs(spark, d),
        "index": b.index(spark, d),
    }
    return features.modality_counts(parts)


@query(
    "leakage_drop",
    f"""{SQL},
raw AS (
  SELECT entity_id, feature, value FROM long
  UNION ALL SELECT entity_id, 'LOS_Hours_total', los_hours FROM idx
  UNION ALL SELECT entity_id, '12345', 1.0 FROM idx)
SELECT feature, count(*) AS n FROM raw
WHERE lower(feature) NOT LIKE '%los_hours%' AND NOT regexp_full_match(feature, '[0-9]+') GROUP BY feature""",
)
def leakage_drop(spark, d):
    leaky = b.index(spark, d).select(
        "entity_id", F.col("los_hours").alias("LOS_Hours_total"), F.lit(1.0).alias("12345")
    )
    blocks = [*b.feature_blocks(spark, d).values(), features.block_to_long(leaky, "leaky")]
    return features.to_long(blocks).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(
    "single_feature_auc",
    f"""{b.COHORT_SQL}, {b.LABS_SQL}, {b.RX_SQL}, {b.VITALS_SQL}, {b.LONG_SQL}, {b.PROFILE_SQL},
c AS (SELECT entity_id, feature, round(value, 6) AS value FROM filled),
r AS (
  SELECT l.feature, l.value, t.prolonged_los_label AS y,
         rank() OVER (PARTITION BY l.feature ORDER BY l.value)
         + (count(*) OVER (PARTITION BY l.feature, l.value) - 1) / 2.0::DOUBLE AS rk
  FROM c l JOIN label_table t USING (entity_id)),
g AS (SELECT feature, sum(y) AS p, count(*) - sum(y) AS n, sum(rk) FILTER (WHERE y = 1) AS s FROM r GROUP BY feature)
SELECT feature, round(CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 6) AS auc,
  round(CASE WHEN p * n > 0 THEN greatest((s - p * (p + 1) / 2.0::DOUBLE) / (p * n),
        1 - (s - p * (p + 1) / 2.0::DOUBLE) / (p * n)) END, 6) AS strength
FROM g""",
)
def single_feature_auc(spark, d):
    """Values are rounded first: ties between means depend on summation order."""
    from staylens.plans.queries_cohort import _label_table

    long = _rounded(b.settled_long(spark, d))
    labels = settle(_label_table(spark, d))
    out = explain.single_feature_auc(long, labels, "prolonged_los_label")
    return out.select("feature", *b.ends(("auc", 6), ("strength", 6)))


@query(
    "linear_contributions_topk",
    """WITH x AS (
  SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
m AS (SELECT i, avg(v) AS mean FROM x GROUP BY i),
c AS (SELECT i, avg(abs((((i * 7) % 11) - 5) / 10.0::DOUBLE * (v - mean))) AS a FROM x JOIN m USING (i) GROUP BY i)
SELECT 'dim_' || i AS feature, round(a, 6) AS mean_abs_contribution FROM c
ORDER BY a DESC, feature LIMIT 25""",
)
def linear_contributions_topk(spark, d):
    base = b.table(spark, d, "embeddings")
    long = base.select(
        F.col("vec_id").alias("entity_id"), F.posexplode("embedding").alias("i", "v")
    )
    long = long.select(
        "entity_id",
        F.concat(F.lit("dim_"), (F.col("i") + 1).cast("string")).alias("feature"),
        F.col("v").cast("double").alias("value"),
    )
    number = F.substring_index("feature", "_", -1).cast("long")
    weights = long.select("feature").distinct().withColumn(
        "weight", (number * 7 % 11 - 5) / F.lit(10.0)
    )
    parts = vectors.linear_contributions(long, weights, base.agg(F.count(F.lit(1))).scalar())
    out = vectors.mean_abs_contribution(parts, top_k=25)
    return out.select("feature", *b.ends(("mean_abs_contribution", 6)))


# The dense matrix: implied zeros filled in, then medians; values rounded as in single_feature_auc.
DENSE = f"""{PROFILE},
c AS (SELECT entity_id, feature, round(value, 6) AS value FROM filled),
med AS (SELECT feature, median(value) AS m, row_number() OVER (ORDER BY feature) - 1 AS ordinal
        FROM c GROUP BY feature),
dense AS (SELECT e.entity_id, med.feature, med.ordinal, coalesce(c.value, med.m) - med.m AS v
          FROM (SELECT DISTINCT entity_id FROM long) e CROSS JOIN med LEFT JOIN c USING (entity_id, feature))"""


def _cells(spark, d):
    """Settled long features, their schema with medians, and the centred cells."""
    long = settle(_rounded(b.settled_long(spark, d)))
    medians = vectors.feature_medians(long)
    schema = settle(
        medians.withColumn("ordinal", F.row_number().over(Window.orderBy("feature")) - 1)
    )
    return long, schema, vectors.centred_cells(long, schema.select("feature", "median"))


@query(
    "sparse_vectors",
    f"{DENSE} SELECT entity_id, ordinal::INT AS ordinal, round(v, 6) AS value FROM dense WHERE v <> 0",
)
def sparse_vectors(spark, d):
    """The stored cells of the vectors that the fits read."""
    long, schema, cells = _cells(spark, d)
    rows = vectors.sparse_vectors(cells, schema, long, schema.count())
    each = rows.select("entity_id", F.posexplode(vector_to_array("vector")).alias("ordinal", "value"))
    return each.filter(F.col("value") != 0).withColumn("value", F.round("value", 6))


@query(
    "linear_importance",
    f"""{DENSE},
w AS (SELECT *, ((ordinal * 7) % 11 - 5) / 10.0::DOUBLE AS w, avg(v) OVER (PARTITION BY feature) AS mean FROM dense)
SELECT feature, round(avg(abs(w * (v - mean))), 6) AS mean_abs_contribution FROM w GROUP BY feature""",
)
def linear_importance(spark, d):
    """Mean absolute contribution over all cells, implied and imputed ones in closed form."""
    long, schema, cells = _cells(spark, d)
    weights = schema.select("feature", ((F.col("ordinal") * 7 % 11 - 5) / F.lit(10.0)).alias("weight"))
    total = long.agg(F.count_distinct("entity_id")).scalar()
    out = vectors.mean_abs_contribution(vectors.linear_contributions(cells, weights, total))
    return out.select("feature", *b.ends(("mean_abs_contribution", 6)))
