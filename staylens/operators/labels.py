"""Outcome labels of the index stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import times
from staylens.functions.numbers import bool_to_int
from staylens.operators import cohort

LABELS = ("mortality_label", "prolonged_los_label", "readmission_label")


def death_flag(days: int = 30, date_granularity: bool = False) -> Column:
    """Death in the stay, or a death date within ``days`` after discharge.

    With ``date_granularity`` only calendar dates are compared, so a date-only
    death on the day of discharge counts.
    """
    dod, disch = F.col("dod"), F.col("disch")
    if date_granularity:
        dod, disch = (c.cast("date").cast("timestamp_ntz") for c in (dod, disch))
    after = (dod >= disch) & (dod <= times.plus_days(disch, days))
    return bool_to_int(F.col("deathtime").isNotNull() | F.coalesce(after, F.lit(False)))


def label_death(
    index: DataFrame,
    entities: DataFrame,
    stays: DataFrame | None = None,
    days: int = 30,
    date_granularity: bool = False,
) -> DataFrame:
    """Mortality label.

    The death time comes from the index row; pass ``stays`` to look it up by
    stay id instead (needed when the index was built first-non-null).
    """
    base = index
    if stays is not None:
        deaths = stays.select("stay_id", "deathtime")
        base = index.drop("deathtime").join(deaths, "stay_id", "left")
    base = base.join(entities.select("entity_id", "dod"), "entity_id", "left")
    return base.select(
        "entity_id", "stay_id", death_flag(days, date_granularity).alias("mortality_label")
    )


def label_prolonged(index: DataFrame, days: int = 7) -> DataFrame:
    """Stay strictly longer than ``days``."""
    long_stay = F.col("los_hours") > F.lit(float(days * 24))
    return index.select("entity_id", "stay_id", bool_to_int(long_stay).alias("prolonged_los_label"))


def readmission_flag(days: int = 30) -> Column:
    """The next stay starts within ``days`` of discharge; none gives 0."""
    return bool_to_int(F.col("next_admit") <= times.plus_days(F.col("disch"), days))


def label_readmission(index: DataFrame, stays: DataFrame, days: int = 30) -> DataFrame:
    """Any stay in (discharge, discharge + days]; the earliest one decides."""
    base = index.join(cohort.next_stay(index, stays), "entity_id", "left")
    return base.select("entity_id", "stay_id", readmission_flag(days).alias("readmission_label"))


def label_table(
    index: DataFrame,
    stays: DataFrame,
    entities: DataFrame,
    hours: float = cohort.HORIZON_HOURS,
    prolonged_days: int = 7,
    death_days: int = 30,
    readmit_days: int = 30,
) -> DataFrame:
    """All labels of entities without an early outcome.

    ``index`` must carry ``los_hours`` and the minimum-stay filter.  The next
    stay is found once and serves both the readmission label and the early
    exclusion; every join is on ``entity_id``, so one partitioning is reused.
    """
    base = index.join(cohort.next_stay(index, stays), "entity_id", "left").join(
        entities.select("entity_id", "dod"), "entity_id", "left"
    )
    ends = dict(zip(cohort.OFFSETS, ("disch", "deathtime", "dod", "next_admit")))
    for name, end in ends.items():
        base = base.withColumn(name, times.hours_between(F.col("admit"), F.col(end)))
    long_stay = F.col("los_hours") > F.lit(float(prolonged_days * 24))
    return base.filter(~cohort.is_early(hours)).select(
        "entity_id",
        "stay_id",
        death_flag(death_days).alias("mortality_label"),
        bool_to_int(long_stay).alias("prolonged_los_label"),
        readmission_flag(readmit_days).alias("readmission_label"),
    )


def prevalence(labels: DataFrame, columns: tuple[str, ...] = LABELS) -> DataFrame:
    """Per label column: rows, positives, mean, range, binary check, class weight."""
    tall = labels.unpivot([], list(columns), "target", "y")
    rate = F.col("prevalence")
    return (
        tall.groupBy("target")
        .agg(
            F.count("y").alias("n"),
            F.sum(F.col("y").cast("long")).alias("n_pos"),
            F.avg(F.col("y").cast("double")).alias("prevalence"),
            F.min("y").alias("min_y"),
            F.max("y").alias("max_y"),
        )
        .withColumn("is_binary", ((F.col("min_y") >= 0) & (F.col("max_y") <= 1)).cast("int"))
        .withColumn("pos_weight", (F.lit(1.0) - rate) / F.greatest(rate, F.lit(1e-6)))
    )
