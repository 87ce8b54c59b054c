"""Ranking, calibration, threshold and bootstrap metrics of scored rows.

Every function takes rows with a 0/1 outcome ``y`` and a score ``p``, and the
grouping columns in ``keys``; one job serves all targets, models, subgroups and
replicates at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.numbers import (
    grid_index,
    grid_value,
    guarded_ratio,
    ratio_or_zero,
)
from staylens.operators.ranking import cumulative_values, exact_quantiles
from staylens.operators.sampling import (
    REPLICATES,
    bootstrap,
    replicate_rows,
    replicate_sums,
)
from staylens.session import attach, settle


def scored_rows(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows with an outcome and a score that is a number; all metrics read these only."""
    score = F.col(p).cast("double")
    return df.filter(score.isNotNull() & ~F.isnan(score) & F.col(y).isNotNull())


def invalid_scores(
    df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per key, and how many of them the metrics leave out."""
    score = F.col(p).cast("double")
    bad = score.isNull() | F.isnan(score) | F.col(y).isNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_invalid")
    )


def score_counts(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Positives and negatives per (keys, distinct score)."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    score = F.col(p).cast("double")
    return (
        scored_rows(df, y, p)
        .groupBy(*keys, score.alias("score"))
        .agg(
            F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg"),
        )
    )


def ranked_scores(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Distinct scores with the confusion counts of ``p >= score``.

    ``tp``/``fp`` include the score itself, ``tp_above``/``fp_above`` do not.
    Equal scores are merged before the ranking, so a score shared by a third of
    the rows is one row here.
    """
    cum = cumulative_values(score_counts(df, y, p, keys, weight), keys, "score", ["pos", "neg"])
    return cum.select(
        *keys,
        "score",
        "pos",
        "neg",
        F.col("total_pos").alias("all_pos"),
        F.col("total_neg").alias("all_neg"),
        (F.col("total_pos") - F.col("cum_pos")).alias("tp_above"),
        (F.col("total_neg") - F.col("cum_neg")).alias("fp_above"),
        (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _precision(tp: str, fp: str) -> Column:
    """Precision, 1 where nothing is selected."""
    picked = _d(tp) + _d(fp)
    return F.when(picked > 0, _d(tp) / picked).otherwise(F.lit(1.0))


# Each adds up over ranked scores.
def _auc() -> Column:
    below = _d("all_neg") - _d("fp")
    area = F.sum(_d("pos") * (below + _d("neg") / 2))
    pairs = F.max(_d("all_pos")) * F.max(_d("all_neg"))
    return F.when(pairs > 0, area / pairs)


def _average_precision() -> Column:
    total = F.max(_d("all_pos"))
    return F.when(total > 0, F.sum(_d("pos") * _precision("tp", "fp")) / total)


def _pr_trapezoid() -> Column:
    total = F.max(_d("all_pos"))
    height = (_precision("tp", "fp") + _precision("tp_above", "fp_above")) / 2
    return F.when(total > 0, F.sum(_d("pos") * height) / total)


def _brier() -> Column:
    score = F.col("score")
    miss, false = score - 1, score
    loss = F.sum(_d("pos") * miss * miss + _d("neg") * false * false)
    return loss / F.sum(_d("pos") + _d("neg"))


def _picked(count: str, threshold: str, above: bool = True) -> Column:
    """Rows of a class at or above (or below) the threshold."""
    inside = F.col("score") >= F.col(threshold)
    return F.coalesce(F.sum(F.when(inside if above else ~inside, F.col(count))), F.lit(0))


def score_metrics(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    weight: str | None = None,
    threshold: str | None = None,
) -> DataFrame:
    """All metrics of a score in one pass over the data.

    Once rows are counted per distinct score, AUC, both PR areas, Brier and
    prevalence are sums over those counts.  With a ``threshold`` column (constant
    per key) the confusion counts come along as tp, fp and fn.
    """
    extra = [threshold] if threshold else []
    ranked = ranked_scores(df, y, p, [*keys, *extra], weight)
    n, n_pos = F.sum(F.col("pos") + F.col("neg")), F.sum("pos")
    figures = [
        n.alias("n"),
        n_pos.alias("n_pos"),
        (n_pos / n).alias("prevalence"),
        _auc().alias("auc"),
        _average_precision().alias("pr_auc"),
        _pr_trapezoid().alias("pr_auc_trapezoid"),
        _brier().alias("brier"),
    ]
    if threshold:
        figures += [
            _picked("pos", threshold).alias("tp"),
            _picked("neg", threshold).alias("fp"),
            _picked("pos", threshold, False).alias("fn"),
        ]
    return ranked.groupBy(*keys, *extra).agg(*figures)


def roc_auc(df, y="y", p="p", keys=(), weight=None) -> DataFrame:
    """Tie-aware area under the ROC curve; NULL with a single class."""
    return ranked_scores(df, y, p, keys, weight).groupBy(*keys).agg(_auc().alias("auc"))


def average_precision(df, y="y", p="p", keys=(), weight=None) -> DataFrame:
    """Step-wise average precision; NULL without positives."""
    ranked = ranked_scores(df, y, p, keys, weight)
    return ranked.groupBy(*keys).agg(_average_precision().alias("pr_auc"))


def pr_auc_trapezoid(df, y="y", p="p", keys=(), weight=None) -> DataFrame:
    """Trapezoidal area under the precision-recall curve."""
    ranked = ranked_scores(df, y, p, keys, weight)
    return ranked.groupBy(*keys).agg(_pr_trapezoid().alias("pr_auc_trapezoid"))


def brier(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared difference of score and outcome."""
    gap = F.col(p) - F.col(y)
    return scored_rows(df, y, p).groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def roc_curve(df, y="y", p="p", keys=(), weight=None) -> DataFrame:
    """One point per distinct score plus the origin (NULL threshold)."""
    ranked = ranked_scores(df, y, p, keys, weight)
    points = ranked.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(_d("fp"), _d("all_neg")).alias("fpr"),
        F.try_divide(_d("tp"), _d("all_pos")).alias("tpr"),
    )
    origin = df.select(*keys, F.lit(None).cast("double").alias("threshold")).distinct()
    origin = origin.select("*", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df, y="y", p="p", keys=(), weight=None) -> DataFrame:
    """One point per distinct score plus the (recall 0, precision 1) end."""
    ranked = ranked_scores(df, y, p, keys, weight)
    points = ranked.select(
        *keys,
        F.col("score").alias("threshold"),
        _precision("tp", "fp").alias("precision"),
        F.try_divide(_d("tp"), _d("all_pos")).alias("recall"),
    )
    end = df.select(*keys, F.lit(None).cast("double").alias("threshold")).distinct()
    end = end.select("*", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def confusion(
    df: DataFrame,
    thr: float | Column,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    zero_division: str = "eps",
) -> DataFrame:
    """Counts, precision, recall and F1 of ``p >= thr``.

    ``zero_division='eps'`` guards ratios with 1e-9; ``'zero'`` returns 0 for an
    empty denominator.
    """
    limit = thr if isinstance(thr, Column) else F.lit(float(thr))
    picked, positive = F.col(p) >= limit, F.col(y) == 1
    counts = scored_rows(df, y, p).groupBy(*keys).agg(
        F.count_if(picked & positive).alias("tp"),
        F.count_if(picked & ~positive).alias("fp"),
        F.count_if(~picked & positive).alias("fn"),
        F.count_if(~picked & ~positive).alias("tn"),
    )
    return with_rates(counts, zero_division)


def with_rates(counts: DataFrame, zero_division: str = "eps") -> DataFrame:
    """Add precision, recall and f1 to tp/fp/fn counts."""
    tp, fp, fn = _d("tp"), _d("fp"), _d("fn")
    if zero_division == "eps":
        rated = counts.withColumn("precision", guarded_ratio(tp, tp + fp)).withColumn(
            "recall", guarded_ratio(tp, tp + fn)
        )
        prec, rec = F.col("precision"), F.col("recall")
        return rated.withColumn("f1", guarded_ratio(F.lit(2.0) * prec * rec, prec + rec))
    if zero_division == "zero":
        return (
            counts.withColumn("precision", ratio_or_zero(tp, tp + fp))
            .withColumn("recall", ratio_or_zero(tp, tp + fn))
            .withColumn("f1", ratio_or_zero(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn))
        )
    raise ValueError(f"unknown zero_division {zero_division!r}")


def cost_fbeta(
    rated: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0, beta: float = 2.0
) -> DataFrame:
    """Add misclassification cost and F-beta to a confusion table."""
    prec, rec, b2 = F.col("precision"), F.col("recall"), F.lit(beta * beta)
    return rated.withColumn(
        "cost", F.lit(cost_fp) * F.col("fp") + F.lit(cost_fn) * F.col("fn")
    ).withColumn("fbeta", guarded_ratio((b2 + 1.0) * prec * rec, b2 * prec + rec))


def threshold_sweep(
    df: DataFrame,
    low: float = 0.01,
    high: float = 0.9,
    points: int = 300,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    zero_division: str = "eps",
) -> DataFrame:
    """Confusion rates at every grid threshold: one scan, ``points`` rows per key.

    Each row falls into one grid bin; counts at a threshold are suffix sums over
    the bins, so the data is read once and aggregated on the map side.
    """
    positive = F.col(y) == 1
    scored = scored_rows(df, y, p)
    bins = (
        scored.groupBy(*keys, grid_index(F.col(p), low, high, points).alias("bin"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    # Zero-count bins make the grid dense; they hang on each key's own bins.
    blank = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long")))
    zero = F.lit(0).cast("long")
    empty = bins.select(*keys).distinct().select(
        *keys, blank.alias("bin"), zero.alias("pos"), zero.alias("neg")
    )
    dense = bins.unionByName(empty).groupBy(*keys, "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    above = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    above = above.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    counts = dense.select(
        *keys,
        "bin",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("fn"),
    ).filter(F.col("bin") >= 0)
    rated = with_rates(counts, zero_division)
    return rated.withColumn("threshold", grid_value(F.col("bin"), low, high, points)).drop("bin")


def best_threshold(
    df: DataFrame,
    low: float = 0.01,
    high: float = 0.9,
    points: int = 300,
    y: str = "y",
    p: str = "p",
    keys: Sequence[str] = (),
    zero_division: str = "eps",
) -> DataFrame:
    """Grid threshold with the highest F1; the smallest wins ties."""
    sweep = threshold_sweep(df, low, high, points, y, p, keys, zero_division)
    fields = ("threshold", "f1", "precision", "recall", "tp", "fp", "fn")
    best = F.max_by(F.struct(*fields), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")
    return sweep.groupBy(*keys).agg(best).select(*keys, "b.*")


def derive_threshold(df, y="y", p="p", keys=()) -> DataFrame:
    """Fallback sweep: 150 points on 0.01-0.99 with zero-safe F1."""
    return best_threshold(df, 0.01, 0.99, 150, y, p, keys, "zero")


def reliability(
    df: DataFrame, n_bins: int = 15, y: str = "y", p: str = "p", keys: Sequence[str] = ()
) -> DataFrame:
    """Reliability curve over quantile bins; empty bins do not appear.

    The bin of a score is the number of inner edges below it.
    """
    df = scored_rows(df, y, p)
    probs = [i / n_bins for i in range(1, n_bins)]
    inner = exact_quantiles(df, p, probs, keys)
    if keys:
        edges = inner.groupBy(*keys).agg(F.collect_list("value").alias("edges"))
        binned = attach(df, edges, list(keys))
    else:
        binned = df.withColumn("edges", inner.agg(F.collect_list("value")).scalar())
    bin_of = F.size(F.filter("edges", lambda e: e < F.col(p).cast("double")))
    return (
        binned.withColumn("bin", bin_of)
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean_predicted"),
            F.avg(F.col(y).cast("double")).alias("observed_rate"),
        )
    )


def calibration_shift(
    df: DataFrame, raw: str = "p_raw", cal: str = "p", keys: Sequence[str] = ()
) -> DataFrame:
    """Mean absolute difference of two scores."""
    shift = F.avg(F.abs(F.col(raw) - F.col(cal)))
    return df.groupBy(*keys).agg(shift.alias("mean_abs_shift"))


def score_histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """Equal-width histogram on [0, 1] per column; empty bins are 0.

    Values that are missing or outside [0, 1] are counted in bin -1, if there are any.
    """
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "p"
    )
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    filled = tall.select(
        "column",
        F.when(F.col("p").between(0.0, 1.0), place).otherwise(-1).cast("long").alias("bin"),
        F.lit(1).cast("long").alias("n"),
    )
    slots = [
        F.struct(F.lit(c).alias("column"), F.lit(b).cast("long").alias("bin"))
        for c in columns
        for b in range(bins)
    ]
    blank = (
        df.sparkSession.range(1)
        .select(F.explode(F.array(*slots)).alias("s"))
        .select("s.*", F.lit(0).cast("long").alias("n"))
    )
    return filled.unionByName(blank).groupBy("column", "bin").agg(F.sum("n").alias("n"))


def summary(
    scored: DataFrame,
    thresholds: DataFrame,
    key: str = "target",
    y: str = "y",
    p: str = "p",
) -> DataFrame:
    """Per-target summary: ranking metrics, Brier, and rates at its threshold.

    ``thresholds`` has one row per target: (target, threshold).
    """
    with_thr = attach(scored, thresholds.select(key, "threshold"), key)
    figures = score_metrics(with_thr, y, p, [key], threshold="threshold")
    return with_rates(figures).select(
        key,
        "auc",
        "pr_auc",
        "brier",
        "threshold",
        F.col("f1").alias("f1_at_threshold"),
        F.col("precision").alias("precision_at_threshold"),
        F.col("recall").alias("recall_at_threshold"),
    )


def compare_models(
    scored: DataFrame, models: Sequence[str], key: str = "target", y: str = "y"
) -> DataFrame:
    """One row per target with AUC, PR-AUC and Brier of every score column."""
    tall = scored.select(key, y, *models).unpivot([key, y], list(models), "model", "p")
    keys = [key, "model"]
    figures = score_metrics(tall, y, "p", keys)
    columns = [
        F.max(F.when(F.col("model") == m, F.col(metric))).alias(f"{m}_{metric}")
        for m in models
        for metric in ("auc", "pr_auc", "brier")
    ]
    return figures.groupBy(key).agg(*columns)


CHUNK = 1 << 14  # distinct scores summed in one group


def replicate_aucs(
    tall: DataFrame, key: str, keys: Sequence[str], n_rep: int, seed: int = 42, y: str = "y"
) -> tuple[DataFrame, DataFrame]:
    """(keys, auc) of the rows themselves, and (keys, replicate, auc) of Poisson replicates.

    The distinct scores are ranked once, for all replicates.  Weights are then summed per
    score as vectors over the replicates; the area is the sum inside chunks of
    neighbouring scores, and chunks add the negatives below them.  State is distinct
    scores x replicates, whatever the number of rows.
    """
    keys = list(keys)
    counts = score_counts(tall, y, "p", keys).withColumn("one", F.lit(1).cast("long"))
    ranked = settle(cumulative_values(counts, keys, "score", ["pos", "neg", "one"]))
    pairs = F.max(_d("total_pos")) * F.max(_d("total_neg"))
    area = F.sum(_d("pos") * (_d("cum_neg") - _d("neg") / 2))
    whole = ranked.groupBy(*keys).agg(F.when(pairs > 0, area / pairs).alias("auc"))

    chunk = F.floor((F.col("cum_one") - 1) / CHUNK).alias("chunk")
    rows = scored_rows(tall, y).select(*keys, key, y, F.col("p").cast("double").alias("score"))
    placed = rows.join(ranked.select(*keys, "score", chunk), [*keys, "score"])
    sums = replicate_sums(
        placed, key, n_rep, [*keys, "chunk", "score"],
        {
            "pos": lambda w: F.when(F.col(y) == 1, w).otherwise(0),
            "neg": lambda w: F.when(F.col(y) == 1, 0).otherwise(w),
        },
        seed,
    )
    each = range(REPLICATES)
    inside = Window.partitionBy(*keys, "chunk", "block").orderBy("score")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.select("*", *[F.sum(f"neg_{j}").over(inside).alias(f"cum_{j}") for j in each])
    parts = running.groupBy(*keys, "chunk", "block").agg(
        *[F.sum(_d(f"pos_{j}") * (_d(f"cum_{j}") - _d(f"neg_{j}") / 2)).alias(f"area_{j}") for j in each],
        *[F.sum(f"{side}_{j}").alias(f"{side}_{j}") for side in ("pos", "neg") for j in each],
    )
    lower = Window.partitionBy(*keys, "block").orderBy("chunk")
    lower = lower.rowsBetween(Window.unboundedPreceding, -1)
    below = [F.coalesce(F.sum(f"neg_{j}").over(lower), F.lit(0)).alias(f"below_{j}") for j in each]
    joined = parts.select("*", *below).groupBy(*keys, "block").agg(
        *[F.sum(_d(f"area_{j}") + _d(f"pos_{j}") * _d(f"below_{j}")).alias(f"area_{j}") for j in each],
        *[(F.sum(_d(f"pos_{j}")) * F.sum(_d(f"neg_{j}"))).alias(f"pairs_{j}") for j in each],
    )
    drawn = replicate_rows(joined, n_rep, keys, ["area", "pairs"])
    auc = F.when(F.col("pairs") > 0, F.col("area") / F.col("pairs")).alias("auc")
    return whole, drawn.select(*keys, "replicate", auc)


def bootstrap_auc_diff(
    scored: DataFrame,
    a: str,
    b: str,
    key: str,
    n_rep: int = 2000,
    q: tuple[float, float] = (0.025, 0.975),
    seed: int = 42,
    method: str = "poisson",
    target: str = "target",
    y: str = "y",
) -> DataFrame:
    """AUC difference a - b with bootstrap interval and two-sided p per target.

    Replicates weigh each row by an independent Poisson(1) count and work on distinct
    scores (``replicate_aucs``); ``exact`` draws as many rows as there are, which writes
    rows x replicates.  Replicates with one class drop out and lower ``n_boot_effective``.
    """
    tall = scored.select(target, key, y, a, b).unpivot([target, key, y], [a, b], "score_name", "p")
    by = [target, "score_name"]

    def auc_gap(auc: DataFrame, keys: list[str]) -> DataFrame:
        sides = [
            F.max(F.when(F.col("score_name") == s, F.col("auc"))).alias(f"auc_{side}")
            for s, side in ((a, "a"), (b, "b"))
        ]
        both = auc.groupBy(*keys).agg(*sides)
        return both.withColumn("diff", F.col("auc_a") - F.col("auc_b"))

    if method == "poisson":
        whole, replicates = replicate_aucs(tall, key, by, n_rep, seed, y)
    else:
        slim = scored.select(target, key, y, a, b)
        drawn = bootstrap(slim, key, n_rep, seed, method, [target])
        kept = [target, "replicate", y, "weight"]
        spread = drawn.select(*kept, a, b).unpivot(kept, [a, b], "score_name", "p")
        whole = roc_auc(tall, y, "p", by)
        replicates = roc_auc(spread, y, "p", [*by, "replicate"], "weight")
    observed = settle(auc_gap(whole, [target]))
    size = scored.groupBy(target).agg(F.count(F.lit(1)).alias("n_test"))
    gaps = auc_gap(replicates, [target, "replicate"]).filter(F.col("diff").isNotNull())
    gaps = gaps.select(target, F.col("diff").alias("boot_diff"))
    # One row per replicate here: n_rep rows per target bound the exact percentile.
    bounds = F.percentile("boot_diff", F.array(*[F.lit(v) for v in q]))
    side = F.when(F.col("diff") >= 0, F.col("boot_diff") <= 0).otherwise(F.col("boot_diff") >= 0)
    spread = (
        gaps.join(observed.select(target, "diff"), target)
        .groupBy(target)
        .agg(
            bounds.alias("ci"),
            F.count_if(side).alias("opposite"),
            F.count(F.lit(1)).alias("n_boot_effective"),
        )
    )
    chance = (F.col("opposite") + 1) / (F.col("n_boot_effective") + 1)
    return (
        observed.join(spread, target)
        .join(size, target)
        .select(
            target,
            "auc_a",
            "auc_b",
            F.col("diff").alias("diff_a_minus_b"),
            F.col("ci")[0].alias("ci_lower"),
            F.col("ci")[1].alias("ci_upper"),
            F.least(F.lit(1.0), F.lit(2.0) * chance).alias("p_two_sided"),
            "n_test",
            "n_boot_effective",
        )
    )


def metric_sanity(
    fresh: DataFrame,
    stored: DataFrame,
    metrics: Sequence[str] = ("auc", "f1"),
    key: str = "target",
    tol: float = 0.01,
) -> DataFrame:
    """Fresh against stored metrics; flagged when a known difference exceeds tol."""
    old = stored.select(key, *[F.col(m).alias(f"{m}_stored") for m in metrics])
    joined = fresh.select(key, *metrics).join(old, key, "left")
    for m in metrics:
        joined = joined.withColumn(f"delta_{m}", F.abs(F.col(m) - F.col(f"{m}_stored")))
    over = [F.coalesce(F.col(f"delta_{m}") > F.lit(tol), F.lit(False)) for m in metrics]
    return joined.withColumn("sanity_flag", reduce(lambda x, z: x | z, over).cast("int"))
