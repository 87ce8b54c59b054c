"""Feature blocks in long form.

``feature_long`` rows are (entity_id, modality, label, stat, feature, value).
NULL values have no row.  A ``measured`` row exists where the label was seen;
for the other entities of the same modality (its members) the value 0 is implied
and is made explicit only in wide form.  Who is a member can be read off an
unpruned frame only, so pruned frames travel with a ``members`` table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from staylens.functions import text, times
from staylens.functions.hashing import order_key
from staylens.functions.numbers import bool_to_int, nan_to_null, steady_moments, to_number
from staylens.functions.text import quoted
from staylens.session import settle

SCHEMA_VERSION = "2025-missingness-v1"  # fixed value, stored with the provenance
STATS = ("mean", "std", "min", "max", "range", "last", "count", "measured")
LONG = ("entity_id", "modality", "label", "stat", "feature", "value")
LEAKAGE_TEXT = "los_hours"


def clean_events(
    events: DataFrame, label: str = "label", value: str = "value", time: str = "t"
) -> DataFrame:
    """Coerce value and time, drop rows where either is missing, normalise labels."""
    kind = events.schema[value].dataType
    number = to_number(F.col(value)) if isinstance(kind, StringType) else F.col(value)
    number = nan_to_null(number.cast("double"))
    when = F.col(time)
    if isinstance(events.schema[time].dataType, StringType):
        when = times.to_time(when)
    return (
        events.withColumn(value, number)
        .withColumn(time, times.plain(when))
        .filter(F.col(value).isNotNull() & F.col(time).isNotNull())
        .withColumn(label, text.normal_label(F.col(label)))
    )


def last_value(events: DataFrame, value: str, time: str, tie: str) -> Column:
    """Value at the latest (time, tie)."""
    if isinstance(events.schema[tie].dataType, IntegralType):
        return F.max_by(value, order_key(times.micros(F.col(time)), F.col(tie)))
    return F.max_by(value, F.struct(time, tie))


def top_labels(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent labels of (label, n), ties by label."""
    return counts.orderBy(F.col("n").desc(), "label").limit(k)


def event_stats(
    events: DataFrame,
    entity: str = "entity_id",
    label: str = "label",
    value: str = "value",
    time: str = "t",
    tie: str = "event_id",
    max_labels: int | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Statistics per (entity, label): mean, std, min, max, range, last, count.

    One hash aggregate over the events.  The label cap is applied afterwards:
    the counts of the result add up to the label frequencies.  The result is
    settled for that, because the optimizer would otherwise push the cap below
    the aggregate and read the events a second time.  Mean and deviation do not
    depend on the order of the events (see ``steady_moments``), so neither does
    a value that is rounded later.
    """
    rows = clean_events(events, label, value, time)
    if labels is not None:
        rows = rows.filter(F.col(label).isin(list(labels)))
    mean, std = steady_moments(F.col(value))
    stats = rows.groupBy(F.col(entity).alias("entity_id"), F.col(label).alias("label")).agg(
        mean.alias("mean"),
        std.alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
        last_value(rows, value, time, tie).alias("last"),
        F.count(value).alias("count"),
    )
    if max_labels is not None:
        stats = settle(stats)
        counts = stats.groupBy("label").agg(F.sum("count").alias("n"))
        # at most max_labels names: small by construction
        kept = F.broadcast(top_labels(counts, max_labels).select("label"))
        stats = stats.join(kept, "label", "left_semi")
    return stats.filter(~text.digits_only(F.col("label"))).select(
        "entity_id", "label", "mean", "std", "min", "max", "range", "last", "count"
    )


def stats_to_long(stats: DataFrame, modality: str) -> DataFrame:
    """Event statistics as feature_long rows, eight per (entity, label)."""
    columns = [
        F.lit(1.0).alias(s) if s == "measured" else F.col(s).cast("double").alias(s)
        for s in STATS
    ]
    tall = stats.select("entity_id", "label", *columns).unpivot(
        ["entity_id", "label"], list(STATS), "stat", "value"
    )
    name = F.concat(F.lit(f"{modality}:"), F.col("label"), F.lit("__"), F.col("stat"))
    return (
        tall.filter(F.col("value").isNotNull())
        .withColumn("modality", F.lit(modality))
        .withColumn("feature", name)
        .select(*LONG)
    )


def count_and_flags(
    events: DataFrame,
    entity: str = "entity_id",
    column: str = "drug",
    patterns: Mapping[str, Sequence[str]] = text.DRUG_PATTERNS,
    total: str | None = "rx_total_mentions",
    unique: str | None = "rx_unique_drugs",
) -> DataFrame:
    """Mentions, distinct texts and any-pattern flags per entity.

    Grouping by (entity, text) first makes the flags and the distinct count one
    pass: each text is matched once and a hot entity is spread over its texts.
    """
    words = events.groupBy(
        F.col(entity).alias("entity_id"), text.lowered(F.col(column)).alias("_word")
    ).agg(F.count(F.lit(1)).alias("_n"))
    out = []
    if total:
        out.append(F.sum("_n").alias(total))
    if unique:
        out.append(F.count(F.lit(1)).alias(unique))
    for name, alternatives in patterns.items():
        out.append(F.max(text.matches_any(F.col("_word"), alternatives).cast("int")).alias(name))
    return words.groupBy("entity_id").agg(*out)


def procedure_flags(
    events: DataFrame,
    entity: str = "entity_id",
    label: str = "item_label",
    fallback: str = "order_description",
    patterns: Mapping[str, Sequence[str]] = text.PROCEDURE_PATTERNS,
) -> DataFrame:
    """Any-pattern flags of procedures; ``fallback`` only if there is no label column."""
    column = label if label in events.columns else fallback
    return count_and_flags(events, entity, column, patterns, None, None)


def demographics(
    index: DataFrame,
    entities: DataFrame,
    rules: Mapping[str, Sequence[str]] = text.ETHNICITY_RULES,
    other: str = text.ETHNICITY_OTHER,
    category: str = "ethnicity",
    prefix: str = "eth",
    top_code: tuple[float, float] = (89.0, 90.0),
    default_age: float = 65.0,
    implausible_age: float | None = None,
) -> DataFrame:
    """Age, gender indicators and one-hot category buckets.

    Missing optional columns fall back to defaults: category UNKNOWN, age 65,
    gender indicators 0.
    """
    wanted = [c for c in ("gender", "dob") if c in entities.columns]
    left = index.select("entity_id", "admit", *[c for c in (category,) if c in index.columns])
    base = left.join(entities.select("entity_id", *wanted), "entity_id", "left")
    if category not in base.columns:
        base = base.withColumn(category, F.lit("UNKNOWN"))
    age = F.lit(float(default_age))
    if "dob" in base.columns:
        age = times.age_years(
            F.col("dob"), F.col("admit"), top_code, default_age, implausible_age
        )
    flags = []
    for code in ("M", "F"):
        same = F.upper(F.col("gender")) == code if "gender" in base.columns else F.lit(False)
        flags.append(bool_to_int(same).alias(f"gender_{code}"))
    named = base.withColumn("_bucket", text.bucket(F.col(category), rules, other))
    hot = [
        (F.col("_bucket") == name).cast("int").alias(f"{prefix}_{name}")
        for name in [*rules, other]
    ]
    return named.select("entity_id", age.alias("age"), *flags, *hot)


def calendar(index: DataFrame, start: str = "admit") -> DataFrame:
    """Admission hour, weekend indicator and month."""
    parts = times.calendar(F.col(start))
    return index.select("entity_id", *[c.alias(name) for name, c in parts.items()])


def block_to_long(block: DataFrame, modality: str) -> DataFrame:
    """A one-row-per-entity block as feature_long rows."""
    names = [c for c in block.columns if c != "entity_id"]
    tall = block.select("entity_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        ["entity_id"], names, "feature", "value"
    )
    none = F.lit(None).cast("string")
    return (
        tall.filter(F.col("value").isNotNull())
        .withColumn("modality", F.lit(modality))
        .withColumn("label", none)
        .withColumn("stat", none)
        .select(*LONG)
    )


def to_long(blocks: Sequence[DataFrame]) -> DataFrame:
    """Union of long blocks without leakage columns and digit-only names."""
    rows = reduce(lambda a, b: a.unionByName(b), blocks)
    return drop_leakage(rows)


def drop_leakage(long: DataFrame, needle: str = LEAKAGE_TEXT) -> DataFrame:
    """Drop features whose name is only digits or contains the leakage text."""
    name = F.col("feature")
    return long.filter(~text.digits_only(name) & ~F.lower(name).contains(needle.lower()))


def leakage_names(long: DataFrame, pattern: str = LEAKAGE_TEXT) -> DataFrame:
    """Distinct feature names that match a leakage pattern, ignoring case."""
    return long.select("feature").distinct().filter(F.lower("feature").rlike(pattern.lower()))


def provenance(long: DataFrame, default: str = "baseline") -> DataFrame:
    """(feature, group) for every feature, plus the schema version row."""
    groups = long.select("feature").distinct().withColumn(
        "group", text.name_group(F.col("feature"), default)
    )
    version = long.sparkSession.range(1).select(
        F.lit("__feature_schema_version__").alias("feature"), F.lit(SCHEMA_VERSION).alias("group")
    )
    return groups.unionByName(version)


def measured_members(long: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(entity_id, modality) pairs, maybe repeated, for which ``measured`` zeros are implied.

    Given ``members`` are returned as they are; a frame without them must be unpruned.
    """
    if members is not None:
        return members.select("entity_id", "modality")
    return long.filter(F.col("stat") == "measured").select("entity_id", "modality")


def to_wide(
    long: DataFrame,
    features: Sequence[str],
    fill: float | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """One row per entity with exactly ``features``, in that order.

    The list is given (a pruned schema), so the pivot needs no extra job.
    ``measured`` features get their implied zeros for the members of the same
    modality, and members have a row even if pruning took all of theirs;
    ``fill`` replaces the remaining NULLs.
    """
    modalities = sorted({f.split(":", 1)[0] for f in features if f.endswith("__measured")})
    rows = long.select("entity_id", "feature", "value")
    if modalities:
        inside = measured_members(long, members).filter(F.col("modality").isin(modalities))
        seen = F.concat(F.lit("__seen:"), "modality").alias("feature")
        rows = rows.unionByName(inside.select("entity_id", seen, F.lit(1.0).alias("value")))
    helpers = [f"__seen:{m}" for m in modalities]
    wide = rows.groupBy("entity_id").pivot("feature", [*features, *helpers]).agg(F.max("value"))
    columns: list[Column] = []
    for f in features:
        column = F.col(quoted(f))
        if f.endswith("__measured"):
            here = F.col(quoted(f"__seen:{f.split(':', 1)[0]}")).isNotNull()
            column = F.coalesce(column, F.when(here, F.lit(0.0)))
        if fill is not None:
            column = F.coalesce(column, F.lit(float(fill)))
        columns.append(column.alias(f))
    return wide.select("entity_id", *columns)


def to_vector(
    long: DataFrame,
    features: Sequence[str],
    fill: float = 0.0,
    members: DataFrame | None = None,
) -> DataFrame:
    """(entity_id, features): dense ML vectors in schema order."""
    from pyspark.ml.functions import array_to_vector

    wide = to_wide(long, features, fill, members)
    dense = F.array(*[F.col(quoted(f)) for f in features])
    return wide.select("entity_id", array_to_vector(dense).alias("features"))


def align(wide: DataFrame, features: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Impose a schema on a wide frame: add missing, drop extra, fix the order."""
    present = set(wide.columns)
    columns = [
        (F.coalesce(F.col(quoted(f)), F.lit(fill)) if f in present else F.lit(fill)).alias(f)
        for f in features
    ]
    return wide.select("entity_id", *columns)


def align_long(long: DataFrame, schema: DataFrame, fill: float | None = None) -> DataFrame:
    """Keep the features of a (feature, ordinal) schema and attach the ordinal.

    With ``fill``, features of the schema that the frame does not hold at all are added
    with that value for every entity of the frame, as the wide form does.
    """
    named = schema.select("feature", "ordinal")
    kept = long.join(named, "feature")
    if fill is None:
        return kept
    absent = settle(named.join(long.select("feature"), "feature", "left_anti"))
    each = absent.agg(F.collect_list(F.struct("feature", "ordinal"))).scalar()
    added = long.select("entity_id").distinct().select("entity_id", F.explode(each).alias("f"))
    values = {"entity_id": F.col("entity_id"), "feature": F.col("f.feature"), "ordinal": F.col("f.ordinal")}
    values["value"] = F.lit(float(fill))
    columns = [
        values.get(c, F.lit(None)).cast(kept.schema[c].dataType).alias(c) for c in kept.columns
    ]
    return kept.unionByName(added.select(*columns))


def modality_counts(parts: Mapping[str, DataFrame], entity: str = "entity_id") -> DataFrame:
    """Rows and distinct entities per modality."""
    tagged = [
        df.select(F.lit(name).alias("modality"), F.col(entity).alias("entity_id"))
        for name, df in parts.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    # count per (modality, entity) first: both numbers from one combined shuffle
    per = rows.groupBy("modality", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("modality").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities")
    )


def join_labels(features: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Features and labels by entity key (never by position).

    A labelled entity without features is an error; ``strict=False`` leaves it out.
    """
    if strict:
        lost = labels.join(features.select("entity_id"), "entity_id", "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"{lost.count()} labelled entities have no features")
    return labels.join(features, "entity_id")


def final_columns(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed output columns, absent ones NULL, ordered by entity."""
    present = set(scored.columns)
    out = [F.col(c) if c in present else F.lit(None).cast("double").alias(c) for c in columns]
    return scored.select("entity_id", *out).orderBy("entity_id")


def baseline_table(
    rows: DataFrame,
    continuous: Sequence[str],
    binary: Sequence[str] = (),
    categorical: Sequence[str] = (),
    split: str = "split",
    splits: Sequence[str] = ("train", "val", "test"),
) -> DataFrame:
    """Baseline characteristics: one row per characteristic, one column per split.

    Continuous values show mean (SD), binary and categorical ones the percent of
    the split.  Columns that are absent are skipped.
    """
    present = set(rows.columns)
    continuous = [c for c in continuous if c in present]
    binary = [c for c in binary if c in present]
    categorical = [c for c in categorical if c in present]
    parts = []
    if continuous:
        numbers = rows.select(split, *[F.col(c).cast("double").alias(c) for c in continuous])
        tall = numbers.unpivot([split], continuous, "characteristic", "v")
        cell = F.format_string("%.2f (%.2f)", F.avg("v"), F.stddev_samp("v"))
        parts.append(tall.groupBy("characteristic", split).agg(cell.alias("cell")))
    if binary:
        numbers = rows.select(split, *[F.col(c).cast("double").alias(c) for c in binary])
        tall = numbers.unpivot([split], binary, "characteristic", "v")
        cell = F.format_string("%.1f%%", F.lit(100.0) * F.avg("v"))
        parts.append(tall.groupBy("characteristic", split).agg(cell.alias("cell")))
    if categorical:
        texts = rows.select(split, *[F.col(c).cast("string").alias(c) for c in categorical])
        tall = texts.unpivot([split], categorical, "name", "v")
        counts = tall.groupBy(split, "name", "v").agg(F.count(F.lit(1)).alias("n"))
        # one row per category here, so the total is a sum over a small group
        total = F.sum("n").over(Window.partitionBy(split, "name"))
        share = F.format_string("%.1f%%", F.lit(100.0) * F.col("n") / total)
        name = F.concat_ws("=", "name", "v")
        parts.append(counts.select(name.alias("characteristic"), split, share.alias("cell")))
    cells = reduce(lambda a, b: a.unionByName(b), parts)
    return cells.groupBy("characteristic").pivot(split, list(splits)).agg(F.first("cell"))
