"""Permutation importance and single-feature ranking checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import quoted
from staylens.operators.features import measured_members
from staylens.operators.metrics import roc_auc
from staylens.operators.ranking import hash_rank


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    key: str = "entity_id",
    y: str = "y",
    seed: int = 42,
) -> DataFrame:
    """AUC lost when one feature at a time is taken from another row.

    ``score`` adds a column ``p`` row by row.  One permutation serves all features: the
    row of rank r under one hash order has the row of rank r under another as its donor,
    an equi join on unique ranks.  Each row then scores itself once per feature with that
    value exchanged, and only (feature, y, p) is shuffled for the ranking.
    """
    base = df.select(key, y, *[F.col(quoted(f)) for f in features])
    names = list(features)
    values = F.struct(*[F.col(quoted(f)).cast("double").alias(f"f{i}") for i, f in enumerate(names)])
    slots = hash_rank(base, key, seed, name="slot").drop("group_size")
    donors = hash_rank(base.select(key, values.alias("donor")), key, seed + 1, name="slot")
    paired = slots.join(donors.select("slot", "donor"), "slot")
    spread = paired.select(
        key, y, "donor", *[F.col(quoted(f)) for f in names],
        F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_at"),
    )
    mixed = spread.select(
        F.element_at(F.array(*[F.lit(f) for f in names]), F.col("_at") + 1).alias("feature"),
        key,
        y,
        *[
            F.when(F.col("_at") == i, F.col(f"donor.f{i}")).otherwise(F.col(quoted(f))).alias(f)
            for i, f in enumerate(names)
        ],
    )
    scored = score(mixed).select("feature", y, "p")
    shuffled = roc_auc(scored, y, "p", ["feature"])
    whole = roc_auc(score(base), y, "p").scalar()
    return shuffled.select(
        "feature",
        whole.alias("base_auc"),
        F.col("auc").alias("shuffled_auc"),
        (whole - F.col("auc")).alias("importance"),
    )


def _implied_zeros(
    long: DataFrame, rows: DataFrame, outcome: DataFrame, y: str, members: DataFrame | None
) -> DataFrame:
    """Implied zeros of ``measured`` features per outcome, as weighted rows."""
    is_measured = F.col("stat") == "measured"
    names = long.filter(is_measured).select("feature", "modality").distinct()
    inside = measured_members(long, members).distinct().join(outcome, "entity_id")
    sizes = inside.groupBy("modality", y).agg(F.count(F.lit(1)).alias("m"))
    stored = rows.filter(is_measured).groupBy("feature", y).agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("m") - F.coalesce(F.col("n"), F.lit(0))
    return (
        names.join(sizes, "modality")
        .join(stored, ["feature", y], "left")
        .select("feature", F.lit(0.0).alias("value"), y, gap.alias("weight"))
        .filter(F.col("weight") > 0)
    )


def single_feature_auc(
    long: DataFrame, labels: DataFrame, y: str = "y", members: DataFrame | None = None
) -> DataFrame:
    """AUC of every feature on its own; ``strength`` ignores the direction.

    A strength near one on a feature that should not know the outcome is a sign
    of leakage.  Implied zeros of ``measured`` features take part by their number.
    """
    outcome = labels.filter(F.col(y).isNotNull()).select("entity_id", y)
    rows = long.join(outcome, "entity_id")
    one = F.lit(1).cast("long").alias("weight")
    cells = rows.select("feature", F.col("value").cast("double").alias("value"), y, one)
    if "stat" in long.columns:
        cells = cells.unionByName(_implied_zeros(long, rows, outcome, y, members))
    auc = roc_auc(cells, y, "value", ["feature"], "weight")
    return auc.withColumn("strength", F.greatest(F.col("auc"), F.lit(1.0) - F.col("auc")))
