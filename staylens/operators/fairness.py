"""Subgroup audit: group metrics, deltas, support, flags and matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import times
from staylens.functions.numbers import ratio_or_zero
from staylens.functions.text import columns_of, group_value, quoted
from staylens.operators.metrics import derive_threshold, score_metrics
from staylens.session import settle

SMALL_GROUP = 30
DELTA = 0.05
GROUP = ("group_category", "group_value")
EVERYONE = "__everyone__"


def indicator_value(column: str) -> Column:
    """Group value of an indicator column: its name after the underscore."""
    return F.when(F.col(quoted(column)) == 1, group_value(F.lit(column)))


def demographic_groups(
    df: DataFrame, gender: str = "gender", ethnicity: str = "ethnicity", age: str = "age"
) -> list[tuple[str, Column]]:
    """Groups of a wide demographics frame: gender_m/f, eth_*, age bands."""
    out = []
    for name in df.columns:
        low = name.lower()
        if low in ("gender_m", "gender_f"):
            out.append((gender, indicator_value(name)))
        elif low.startswith("eth_"):
            out.append((ethnicity, indicator_value(name)))
    if age in df.columns:
        out.append(("age_band", times.age_band(F.col(age))))
    return out


def explode_groups(
    df: DataFrame, groups: Mapping[str, Column] | Sequence[tuple[str, Column]], everyone: bool = False
) -> DataFrame:
    """One row per scored row and group it belongs to; NULL values are no group."""
    pairs = list(groups.items()) if isinstance(groups, Mapping) else list(groups)
    if everyone:
        pairs.append((EVERYONE, F.lit(EVERYONE)))
    members = [
        F.struct(F.lit(c).alias(GROUP[0]), v.cast("string").alias(GROUP[1])) for c, v in pairs
    ]
    present = F.filter(F.array(*members), lambda m: m[GROUP[1]].isNotNull())
    return df.select("*", F.explode(present).alias("_g")).select(
        *columns_of(df), f"_g.{GROUP[0]}", f"_g.{GROUP[1]}"
    )


def group_metrics(
    scored: DataFrame,
    groups: Mapping[str, Column] | Sequence[tuple[str, Column]],
    small_n: int = SMALL_GROUP,
    target: str = "target",
    threshold: str = "threshold",
    source: str = "prob_source",
) -> DataFrame:
    """Metrics per (target, category, value) with deltas to the whole target.

    The whole target is one more group, so a single pass measures everything;
    its values reach the other rows through a window over the small result.  A
    hot group is no problem: counts combine on the map side and the ranking is
    spread over score cells.  The threshold is constant per target.  Every group
    has a row: ``small`` marks those below ``small_n`` rows, a target with one
    class has no AUC, and ``cohort_n`` is the size of the whole target.
    """
    if source not in scored.columns:
        scored = scored.withColumn(source, F.lit("score"))
    rows = explode_groups(scored, groups, everyone=True)
    keys = [target, source, *GROUP]
    figures = score_metrics(rows, "y", "p", keys, threshold=threshold)
    figures = figures.withColumnRenamed(threshold, "threshold")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    joined = (
        figures.withColumn("f1_safe", ratio_or_zero(2 * tp, 2 * tp + fp + fn))
        .withColumn("f1", F.when(F.col("n_pos") > 0, F.col("f1_safe")))
        .withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
    )
    whole = Window.partitionBy(target)
    is_all = F.col(GROUP[0]) == EVERYONE
    for metric, base in (("auc", "auc"), ("f1", "f1_safe")):
        overall = F.max(F.when(is_all, F.col(base))).over(whole)
        joined = joined.withColumn(f"global_{metric}", overall)
        joined = joined.withColumn(f"delta_{metric}", F.col(metric) - F.col(f"global_{metric}"))
    joined = joined.withColumn("cohort_n", F.max(F.when(is_all, F.col("n"))).over(whole))
    joined = joined.withColumn("small", F.col("n") < small_n)
    return joined.filter(~is_all).select(
        target, source, *GROUP, "n", "cohort_n", "small", "prevalence", "auc", "pr_auc", "brier", "threshold", "f1",
        "precision", "recall", "global_auc", "global_f1", "delta_auc", "delta_f1",
    )


def fairness_table(
    rows: DataFrame,
    targets: Mapping[str, tuple[str, str]],
    thresholds: Mapping[str, float | None] | None = None,
    groups: Mapping[str, Column] | Sequence[tuple[str, Column]] | None = None,
    test_ids: DataFrame | None = None,
    test_only: bool = True,
    sources: Mapping[str, str] | None = None,
    small_n: int = SMALL_GROUP,
    key: str = "entity_id",
) -> DataFrame:
    """The whole audit: one row per target, category and value, in that order.

    ``rows`` holds labels, scores and demographics of an entity; ``targets`` names the
    label and the score column of each target.  Without ``groups`` those of the
    demographics are taken.  ``test_only`` restricts to ``test_ids`` and refuses to run
    without them.  A target with one class is left out; one without a threshold gets the
    fallback sweep's.  A table without rows is an error.
    """
    if test_only:
        if test_ids is None:
            raise ValueError("a test-only table needs the ids of the test split")
        rows = rows.join(test_ids.select(key).distinct(), key, "left_semi")
    groups = demographic_groups(rows) if groups is None else groups
    each = [
        F.struct(
            F.lit(target).alias("target"),
            F.col(quoted(label)).cast("int").alias("y"),
            F.col(quoted(score)).cast("double").alias("p"),
            F.lit((sources or {}).get(target, "score")).alias("prob_source"),
            F.lit((thresholds or {}).get(target)).cast("double").alias("threshold"),
        )
        for target, (label, score) in targets.items()
    ]
    pairs = list(groups.items()) if isinstance(groups, Mapping) else list(groups)
    named = [(c, f"_group{i}", v) for i, (c, v) in enumerate(pairs)]
    tall = rows.select(*[v.alias(n) for _, n, v in named], F.explode(F.array(*each)).alias("t"))
    tall = settle(tall.select(*[n for _, n, _ in named], "t.*"))
    classes = tall.groupBy("target").agg(F.count_distinct("y").alias("classes"))
    derived = derive_threshold(tall, keys=["target"]).select("target", F.col("threshold").alias("derived"))
    usable = classes.filter("classes > 1").join(derived, "target", "left")
    given = F.when(F.isnan("threshold"), None).otherwise(F.col("threshold"))
    scored = tall.join(usable.select("target", "derived"), "target").withColumn(
        "threshold", F.coalesce(given, F.col("derived"))
    )
    out = group_metrics(scored, [(c, F.col(n)) for c, n, _ in named], small_n)
    out = settle(out)
    if out.isEmpty():
        raise ValueError("no target has two classes and a group")
    return out.orderBy("target", *GROUP)


def support(metrics: DataFrame) -> DataFrame:
    """Size of each group (largest over targets) and its percent of the largest cohort."""
    sizes = metrics.groupBy(*GROUP).agg(F.max("n").alias("n"))
    cohort = metrics.agg(F.max("cohort_n")).scalar()
    return sizes.withColumn("pct", F.round(F.col("n") / cohort * 100, 2))


def overview(metrics: DataFrame, target: str = "target") -> DataFrame:
    """Per target and category: groups, size range and mean deltas."""
    return metrics.groupBy(target, GROUP[0]).agg(
        F.count_distinct(GROUP[1]).alias("groups"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.avg("delta_auc").alias("mean_delta_auc"),
        F.avg("delta_f1").alias("mean_delta_f1"),
    )


def flags(metrics: DataFrame, limit: float = DELTA, target: str = "target") -> DataFrame:
    """Groups whose AUC or F1 is further than ``limit`` from the whole target."""

    def far(column: str) -> Column:
        return F.coalesce(F.abs(F.col(column)) > limit, F.lit(False))

    return metrics.filter(far("delta_auc") | far("delta_f1")).orderBy(
        target, GROUP[0], F.col("delta_f1").desc_nulls_last(), GROUP[1]
    )


def domain_order(category: str, value: str) -> Column:
    """Sort key of a group: age bands by their lower bound, M before F, else by name."""
    text = F.col(value)
    number = F.regexp_extract(text, r"(\d+)", 1).try_cast("double")
    age = F.when(text.startswith("<"), F.lit(-0.1)).otherwise(
        F.coalesce(number, F.lit(9e9))
    )
    sex = F.when(F.upper(text) == "M", 0.0).when(F.upper(text) == "F", 1.0).otherwise(2.0)
    return (
        F.when(F.col(category) == "age_band", age)
        .when(F.col(category) == "gender", sex)
        .otherwise(F.lit(0.0))
    )


def ordered(metrics: DataFrame, target: str = "target") -> DataFrame:
    """Metric rows in domain order."""
    return metrics.orderBy(target, GROUP[0], domain_order(*GROUP), GROUP[1])


def matrix(
    metrics: DataFrame, targets: Sequence[str], value: str = "auc", target: str = "target"
) -> DataFrame:
    """One row per group, one column per target."""
    cells = metrics.groupBy(*GROUP).pivot(target, list(targets)).agg(F.first(value))
    return cells


def prevalence_relation(metrics: DataFrame, target: str = "target") -> DataFrame:
    """Prevalence next to AUC for every group."""
    return metrics.select(target, *GROUP, "n", "prevalence", "auc")
