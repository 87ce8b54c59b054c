"""Fit, tune, calibrate and apply binary classifiers with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import columns_of, quoted
from staylens.operators.isotonic import apply_steps, fit_steps
from staylens.operators.metrics import best_threshold, roc_auc
from staylens.operators.sampling import downsample_majority, stratified_folds
from staylens.session import settle

# Search ranges of the tree parameters.  Spark's gain is a mean
# per row, so the split penalty (0 to 4 as a summed loss) is scaled down.
SEARCH_RANGES = {
    "stepSize": (0.01, 0.2, "log"),
    "maxDepth": (3, 7, "int"),
    "minInstancesPerNode": (1, 8, "int"),
    "subsamplingRate": (0.6, 1.0, "float"),
    "featureSubsetStrategy": (0.6, 1.0, "text"),
    "minInfoGain": (0.0, 0.004, "float"),
    "maxIter": (120, 400, "int"),
}
SPEED_CAP = 12_000


def class_weight(df: DataFrame, y: str = "y") -> tuple[float, float]:
    """(positive share, weight of a positive against a negative)."""
    row = df.agg(F.avg(F.col(y).cast("double")).alias("p")).first()
    share = float(row["p"] or 0.0)
    return share, (1.0 - share) / max(share, 1e-6)


def _prepare(features: Sequence[str] | str, scale: bool) -> list:
    """Median imputation and assembly, saved with the model for train and score alike.

    The name of a vector column stands for rows that ``vectors`` has imputed.
    """
    if isinstance(features, str):
        named = SQLTransformer(statement=f"SELECT *, {quoted(features)} AS assembled FROM __THIS__")
        return [named, *([_scaler()] if scale else [])]
    raw = [f"raw_{i}" for i in range(len(features))]
    filled = [f"filled_{i}" for i in range(len(features))]
    casts = ", ".join(f"CAST({quoted(f)} AS DOUBLE) AS {r}" for f, r in zip(features, raw))
    stages = [
        SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
        Imputer(strategy="median", inputCols=raw, outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
    ]
    return [*stages, *([_scaler()] if scale else [])]


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="assembled", outputCol="features", withMean=False, withStd=True)


def baseline_logistic(
    train: DataFrame, features: Sequence[str] | str, y: str = "y", max_iter: int = 500
) -> PipelineModel:
    """Median impute, scale without centring, class-balanced logistic regression."""
    share, _ = class_weight(train, y)
    weight = F.when(F.col(y) == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1.0 - share, 1e-6))
    learner = LogisticRegression(
        labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter
    )
    rows = train.withColumn("weight", weight).withColumn("label", F.col(y).cast("double"))
    return Pipeline(stages=[*_prepare(features, True), learner]).fit(rows)


def boosted_trees(
    train: DataFrame,
    features: Sequence[str] | str,
    params: Mapping[str, object] | None = None,
    y: str = "y",
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees; positives weigh (1-p)/p."""
    _, heavier = class_weight(train, y)
    learner = GBTClassifier(
        labelCol="label", featuresCol="assembled", weightCol="weight", seed=seed, **(params or {})
    )
    weight = F.when(F.col(y) == 1, F.lit(heavier)).otherwise(F.lit(1.0))
    rows = train.withColumn("weight", weight).withColumn("label", F.col(y).cast("double"))
    return Pipeline(stages=[*_prepare(features, False), learner]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the positive-class probability under ``name``; other columns stay."""
    scored = model.transform(df)
    return scored.select(*columns_of(df), vector_to_array("probability")[1].alias(name))


def draw_params(
    trials: int, seed: int = 42, ranges: Mapping[str, tuple] = SEARCH_RANGES
) -> list[dict[str, object]]:
    """Seeded random parameter sets."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        chosen: dict[str, object] = {}
        for name, (low, high, kind) in ranges.items():
            if kind == "int":
                chosen[name] = rng.randint(int(low), int(high))
            elif kind == "log":
                chosen[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "text":
                chosen[name] = f"{rng.uniform(low, high):.3f}"
            else:
                chosen[name] = rng.uniform(low, high)
        out.append(chosen)
    return out


@dataclass
class Tuned:
    """``scores``: (rung, trial, mean_auc, n_folds, share, params); the best of the last rung."""

    scores: DataFrame
    best: dict[str, object]
    best_auc: float


def tune(
    train: DataFrame,
    features: Sequence[str] | str,
    trials: Sequence[Mapping[str, object]],
    folds: int = 5,
    y: str = "y",
    key: str = "entity_id",
    cap: int = SPEED_CAP,
    seed: int = 42,
    rungs: Sequence[float] = (0.2, 1.0),
    keep: float = 1 / 3,
    workers: int = 4,
) -> Tuned:
    """Cross-validated AUC of parameter sets, poor ones stopped early.

    Successive halving: a rung fits every trial left with a share of its iterations, and
    the better ``keep`` of them go on; the last rung runs them whole.  Folds are
    stratified and written once; a training fold above ``cap`` rows keeps its positives
    and a sample of its negatives.  Up to ``workers`` fits of a rung run at a time, and the
    predictions of all its trials and folds are ranked in one job.
    """
    if not trials or not rungs or rungs[-1] != 1.0:
        raise ValueError("there must be trials, and the last rung must be whole")
    folded = settle(stratified_folds(train, key, y, folds, seed))
    bases = [
        settle(downsample_majority(folded.filter(F.col("fold") != fold), key, y, cap, seed + fold + 1))
        for fold in range(folds)
    ]
    left, out, best = list(range(len(trials))), None, None
    for rung, share in enumerate(rungs):

        def held(job: tuple[int, int]) -> DataFrame:
            number, fold = job
            params = dict(trials[number])
            if "maxIter" in params:
                params["maxIter"] = max(1, math.ceil(params["maxIter"] * share))
            fitted = boosted_trees(bases[fold], features, params, y, seed)
            scored = predict(fitted, folded.filter(F.col("fold") == fold))
            return scored.select(F.lit(number).alias("trial"), F.lit(fold).alias("fold"), y, "p")

        jobs = [(number, fold) for number in left for fold in range(folds)]
        with ThreadPoolExecutor(max(1, workers)) as pool:
            parts = list(pool.map(inheritable_thread_target(train.sparkSession)(held), jobs))
        per_fold = roc_auc(reduce(lambda a, b: a.unionByName(b), parts), y, "p", ["trial", "fold"])
        scores = settle(
            per_fold.groupBy("trial")
            .agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_folds"))
            .select(F.lit(rung).alias("rung"), "*", F.lit(float(share)).alias("share"))
        )
        out = scores if out is None else out.unionByName(scores)
        ranked = sorted(scores.collect(), key=lambda r: (-(r["mean_auc"] or 0.0), r["trial"]))
        best = ranked[0]  # one row per trial
        left = [r["trial"] for r in ranked[: max(1, math.ceil(len(ranked) * keep))]]
    texts = [
        F.struct(F.lit(i).alias("trial"), F.lit(str(dict(p))).alias("params"))
        for i, p in enumerate(trials)
    ]
    names = train.sparkSession.range(1).select(F.explode(F.array(*texts)).alias("t")).select("t.*")
    return Tuned(out.join(names, "trial"), dict(trials[best["trial"]]), float(best["mean_auc"] or 0.0))


def tune_target(
    rows: DataFrame,
    features: Sequence[str] | str,
    n_trials: int = 25,
    y: str = "y",
    seed: int = 42,
    ranges: Mapping[str, tuple] = SEARCH_RANGES,
    with_full: bool = True,
    **how,
) -> tuple[TargetModel, Tuned]:
    """Draw parameter sets, tune them on the train split, refit the best, calibrate."""
    train = rows.filter(F.col("split") == "train")
    tuned = tune(train, features, draw_params(n_trials, seed, ranges), y=y, seed=seed, **how)
    return fit_target(rows, features, tuned.best, y, with_full, seed), tuned


def fit_calibrator(
    valid: DataFrame, p: str = "p_raw", y: str = "y", keys: Sequence[str] = ()
) -> DataFrame:
    """Isotonic map of raw scores as a table of steps, constant outside the fitted range."""
    return fit_steps(valid, p, y, keys)


def calibrate(
    df: DataFrame,
    calibrator: DataFrame | None,
    p: str = "p_raw",
    name: str = "p",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the calibrated score; without a calibrator the raw one."""
    if calibrator is None:
        return df.withColumn(name, F.col(quoted(p)))
    return apply_steps(df, calibrator, p, name, keys)


@dataclass
class TargetModel:
    """What one target needs for scoring and reporting."""

    base: PipelineModel
    full: PipelineModel | None
    calibrator: DataFrame | None
    threshold: float


def fit_target(
    rows: DataFrame,
    features: Sequence[str] | str,
    params: Mapping[str, object] | None = None,
    y: str = "y",
    with_full: bool = True,
    seed: int = 42,
) -> TargetModel:
    """Train-only model, train+val model, isotonic map and F1 threshold.

    ``rows`` carries ``split``; the calibrator and the threshold see validation
    rows only.
    """
    train = rows.filter(F.col("split") == "train")
    valid = rows.filter(F.col("split") == "val")
    base = boosted_trees(train, features, params, y, seed)
    full = boosted_trees(train.unionByName(valid), features, params, y, seed) if with_full else None
    raw = predict(base, valid, "p_raw").select(y, "p_raw")
    raw = settle(raw)
    calibrator = fit_calibrator(raw, "p_raw", y)
    best = best_threshold(calibrate(raw, calibrator), y=y, p="p").first()
    return TargetModel(base, full, calibrator, float(best["threshold"]))


def score(
    wide: DataFrame, models: Mapping[str, TargetModel], names: Mapping[str, str] | None = None
) -> DataFrame:
    """Calibrated probability columns for every target."""
    out = wide
    columns = []
    for target, model in models.items():
        name = (names or {}).get(target, f"{target}_proba")
        raw = predict(model.base, out, f"{target}_raw")
        out = calibrate(raw, model.calibrator, f"{target}_raw", name).drop(f"{target}_raw")
        columns.append(name)
    return out.select("entity_id", *columns)


def gain_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Model-native importance of a tree model, one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(
        F.col("gain").desc(), "feature"
    )


def logistic_weights(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, weight) of the baseline on the original, unscaled values."""
    spread = model.stages[-2].std.toArray()
    weights = model.stages[-1].coefficients.toArray()
    rows = [
        (f, float(w / s) if s > 0 else 0.0) for f, w, s in zip(features, weights, spread)
    ]
    return spark.createDataFrame(rows, "feature string, weight double")
