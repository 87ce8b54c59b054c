"""Index stays, stay length, early-event exclusion and attrition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, TimestampNTZType, TimestampType

from staylens.functions import times
from staylens.functions.hashing import TIME_SHIFT, order_key

HORIZON_HOURS = 54.0
OFFSETS = (
    "hours_to_discharge",
    "hours_to_stay_death",
    "hours_to_death_date",
    "hours_to_next_stay",
)


def _order(rows: DataFrame, start: str, tie: str) -> Column:
    """Sort key of a stay: by start, missing starts last, then by id.

    Packed into a decimal where the id is a whole number, else a struct.
    """
    if isinstance(rows.schema[tie].dataType, IntegralType):
        return order_key(times.micros(F.col(start)), F.col(tie))
    return F.struct(F.col(start).isNull(), F.col(start), F.col(tie))


def _with_least(rows: DataFrame, entity: str, order: Column) -> DataFrame:
    """The row of least order per entity, of equal ones that of the least hash.

    The minimum is a hash aggregate, combined on the map side; rows then meet it by their
    entity, and only rows that share the minimum are ranked.
    """
    keyed = rows.withColumn("_order", order)
    least = keyed.groupBy(F.col(entity).alias("_entity")).agg(F.min("_order").alias("_least"))
    found = keyed.join(
        least, keyed[entity].eqNullSafe(least["_entity"]) & keyed["_order"].eqNullSafe(least["_least"])
    )
    ties = Window.partitionBy(entity).orderBy(F.xxhash64(*rows.columns))
    return found.withColumn("_nth", F.row_number().over(ties)).filter("_nth = 1").select(rows.columns)


def index_stay(
    stays: DataFrame,
    entity: str = "entity_id",
    start: str = "admit",
    tie: str = "stay_id",
    mode: str = "first_row",
) -> DataFrame:
    """One stay per entity: the earliest.

    ``first_row`` returns the true first stay.  ``first_non_null`` fills every
    column from the first stay in which it is present, so a row may combine
    several stays.  Both start from minima of a packed order key: an entity with very
    many stays never meets in one task, as it would under a ranking window over them.
    """
    order = _order(stays, start, tie)
    others = [c for c in stays.columns if c != entity]
    if mode == "first_row":
        return _with_least(stays, entity, order)
    if mode == "first_non_null":
        keyed = stays.withColumn("_order", order).withColumn("_of", F.col(entity))
        present = [
            F.min(F.when(F.col(c).isNotNull(), F.col("_order"))).alias(f"_at{i}")
            for i, c in enumerate(others)
        ]
        least = keyed.groupBy(F.col(entity).alias("_entity")).agg(*present)
        marks = [F.col(f"_at{i}") for i in range(len(others))]
        wanted = keyed["_of"].eqNullSafe(least["_entity"]) & F.col("_order").isin(*marks)
        # At most one stay per column is left of each entity; a list of one value each.
        held = keyed.drop(entity).join(least, wanted, "right")
        firsts = [
            F.get(F.sort_array(F.collect_list(F.when(F.col("_order") == at, F.col(c)))), F.lit(0)).alias(c)
            for at, c in zip(marks, others)
        ]
        return held.groupBy(F.col("_entity").alias(entity)).agg(*firsts).select(stays.columns)
    raise ValueError(f"unknown mode {mode!r}")


def with_los(stays: DataFrame, start: str = "admit", end: str = "disch") -> DataFrame:
    """Add ``los_hours``, the fractional elapsed stay length."""
    return stays.withColumn("los_hours", times.hours_between(F.col(start), F.col(end)))


def min_stay(stays: DataFrame, hours: float = HORIZON_HOURS) -> DataFrame:
    """Keep stays of at least ``hours`` (inclusive)."""
    return stays.filter(F.col("los_hours") >= F.lit(float(hours)))


def within_cohort(rows: DataFrame, cohort: DataFrame, on: str = "entity_id") -> DataFrame:
    """Keep the rows whose key is in the cohort."""
    return rows.join(cohort.select(on), on, "left_semi")


def one_per_entity(rows: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Deduplicate to one row per entity, the smallest by ``order``, missing values first.

    A whole number, or a time and a whole number, is packed; other orders are a struct,
    whose minimum needs a sort.
    """
    kinds = [rows.schema[c].dataType for c in order]
    if len(order) == 1 and isinstance(kinds[0], IntegralType):
        return _with_least(rows, entity, F.coalesce(F.col(order[0]).cast("decimal(20,0)"), F.lit(str(-(2**64))).cast("decimal(20,0)")))
    if len(order) == 2 and isinstance(kinds[0], (TimestampType, TimestampNTZType)) and isinstance(kinds[1], IntegralType):
        early = F.coalesce(times.micros(F.col(order[0])), F.lit(-TIME_SHIFT))
        return _with_least(rows, entity, order_key(early, F.col(order[1])))
    return _with_least(rows, entity, F.struct(*order))


def next_stay(index: DataFrame, stays: DataFrame) -> DataFrame:
    """Start of the first stay strictly after the index discharge, per entity.

    The inequality sits in the join next to the equi key, so rows before the
    discharge die inside the join and only a partial minimum is shuffled.
    """
    first = index.select("entity_id", F.col("disch").alias("first_disch"))
    after = stays.select("entity_id", "admit").join(first, "entity_id")
    return (
        after.filter(F.col("admit") > F.col("first_disch"))
        .groupBy("entity_id")
        .agg(F.min("admit").alias("next_admit"))
    )


def early_event_offsets(
    index: DataFrame, stays: DataFrame, entities: DataFrame | None = None
) -> DataFrame:
    """Hours from index admission to discharge, death in stay, death date, next stay."""
    base = index.join(next_stay(index, stays), "entity_id", "left")
    if entities is not None and "dod" in entities.columns:
        base = base.join(entities.select("entity_id", "dod"), "entity_id", "left")
    else:
        base = base.withColumn("dod", F.lit(None).cast("timestamp_ntz"))
    ends = dict(zip(OFFSETS, ("disch", "deathtime", "dod", "next_admit")))
    return base.select(
        "entity_id",
        *[times.hours_between(F.col("admit"), F.col(c)).alias(name) for name, c in ends.items()],
    )


def is_early(hours: float = HORIZON_HOURS, offsets: Sequence[str] = OFFSETS) -> Column:
    """True when any known offset is at or before the horizon."""
    early = F.lit(False)
    for name in offsets:
        early = early | F.coalesce(F.col(name) <= F.lit(float(hours)), F.lit(False))
    return early


def exclude_early(
    index: DataFrame, offsets: DataFrame, hours: float = HORIZON_HOURS
) -> DataFrame:
    """Drop entities with an outcome at or before the horizon."""
    early = offsets.filter(is_early(hours)).select("entity_id")
    return index.join(early, "entity_id", "left_anti")


def attrition(steps: Mapping[str, DataFrame], entity: str = "entity_id") -> DataFrame:
    """Rows and distinct entities left after each named step, in order."""
    out = None
    for position, (name, df) in enumerate(steps.items()):
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities")
        ).select(F.lit(position).alias("ordinal"), F.lit(name).alias("step"), "n_rows", "n_entities")
        out = row if out is None else out.unionByName(row)
    return out
