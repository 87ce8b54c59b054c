"""Training-side build and scoring of unseen entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import DRUG_PATTERNS, ETHNICITY_RULES, PROCEDURE_PATTERNS
from staylens.operators import cohort, features, labels, models, prune, sampling, vectors, window
from staylens.session import settle, tune
from staylens.sources.files import schema_names
from staylens.sources.tables import id_frame

# Target -> label column, and target -> output column.
TARGETS = {
    "readmission": "readmission_label",
    "mortality": "mortality_label",
    "prolonged_los": "prolonged_los_label",
}
OUTPUTS = {
    "mortality": "mortality_proba",
    "prolonged_los": "prolonged_LOS_proba",
    "readmission": "readmission_proba",
}


@dataclass
class Sources:
    """Bound source tables (generic column names); events may be absent."""

    stays: DataFrame
    entities: DataFrame
    vitals: DataFrame | None = None
    labs: DataFrame | None = None
    rx: DataFrame | None = None
    proc: DataFrame | None = None
    items: DataFrame | None = None
    lab_items: DataFrame | None = None


@dataclass
class Config:
    """Thresholds and patterns of a build."""

    window_hours: int = window.WINDOW_HOURS
    window_mode: str = "clock_hour"
    horizon_hours: float = cohort.HORIZON_HOURS
    prolonged_days: int = 7
    min_support: int = 1
    top_k: int | None = None
    max_labels: int | None = None
    min_variable_fraction: float = 0.2
    min_scoring_fraction: float = 0.10
    seed: int = 42
    category_rules: Mapping[str, Sequence[str]] = field(default_factory=lambda: ETHNICITY_RULES)
    drug_patterns: Mapping[str, Sequence[str]] = field(default_factory=lambda: DRUG_PATTERNS)
    procedure_patterns: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: PROCEDURE_PATTERNS
    )


@dataclass
class Training:
    """Result of the training-side build.

    ``members`` is (entity_id, modality) of the unpruned features: pruned rows
    alone do not tell where ``measured`` zeros are implied.
    """

    index: DataFrame
    labels: DataFrame
    features: DataFrame
    schema: DataFrame
    names: list[str]
    counts: DataFrame
    members: DataFrame


# --- slices ----------------------------------------------------------------
def _sliced(events: DataFrame, index: DataFrame, config: Config) -> DataFrame:
    return window.early_window(
        events,
        index,
        hours=config.window_hours,
        mode=config.window_mode,
        carry=["entity_id"],
        prune_scan=True,
    )


def measured_slice(
    events: DataFrame,
    items: DataFrame | None,
    index: DataFrame,
    config: Config,
    require_value: bool,
) -> DataFrame:
    """Windowed measurements with their item label; unknown items are dropped."""
    rows = events.filter(F.col("value").isNotNull()) if require_value else events
    rows = _sliced(rows, index, config)
    if items is None:
        return rows
    return window.join_items(rows, items.select("item_id", "item_label"), "item_id", "inner")


def order_slice(events: DataFrame, index: DataFrame, config: Config) -> DataFrame:
    """Windowed orders (prescriptions)."""
    return _sliced(events, index, config)


def procedure_slice(
    events: DataFrame, items: DataFrame | None, index: DataFrame, config: Config
) -> DataFrame:
    """Windowed procedures; the label is NULL where the item is unknown."""
    rows = _sliced(events, index, config)
    if items is None:
        return rows
    return window.join_items(rows, items.select("item_id", "item_label"), "item_id", "left")


def modality_bundle(sources: Sources, index: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Lazy slices per modality; absent modalities are left out."""
    bundle = {"demo": cohort.within_cohort(sources.entities, index)}
    if sources.vitals is not None:
        bundle["vitals"] = measured_slice(sources.vitals, sources.items, index, config, True)
    if sources.labs is not None:
        bundle["labs"] = measured_slice(sources.labs, sources.lab_items, index, config, False)
    if sources.rx is not None:
        bundle["rx"] = order_slice(sources.rx, index, config)
    if sources.proc is not None:
        bundle["proc"] = procedure_slice(sources.proc, sources.items, index, config)
    return bundle


def feature_blocks(
    index: DataFrame, bundle: Mapping[str, DataFrame], config: Config
) -> DataFrame:
    """All blocks of the bundle as one feature_long frame without leakage columns."""
    blocks = []
    demo = features.demographics(index, bundle["demo"], config.category_rules)
    blocks.append(features.block_to_long(demo, "demo"))
    for name in ("vitals", "labs"):
        if name in bundle:
            rows = bundle[name]
            tie = "event_id" if "event_id" in rows.columns else "value"
            stats = features.event_stats(
                rows, label="item_label", tie=tie, max_labels=config.max_labels
            )
            blocks.append(features.stats_to_long(stats, name))
    if "rx" in bundle:
        rx = features.count_and_flags(bundle["rx"], patterns=config.drug_patterns)
        blocks.append(features.block_to_long(rx, "rx"))
    if "proc" in bundle:
        proc = features.procedure_flags(bundle["proc"], patterns=config.procedure_patterns)
        blocks.append(features.block_to_long(proc, "proc"))
    blocks.append(features.block_to_long(features.calendar(index), "calendar"))
    return features.to_long(blocks)


# --- training --------------------------------------------------------------
def _index_stays(sources: Sources, cohort_ids: DataFrame | None, config: Config) -> DataFrame:
    stays = sources.stays
    if cohort_ids is not None:
        stays = cohort.within_cohort(stays, cohort_ids)
    return cohort.min_stay(cohort.with_los(cohort.index_stay(stays)), config.horizon_hours)


def _labels(sources: Sources, index: DataFrame, config: Config) -> DataFrame:
    return labels.label_table(
        index, sources.stays, sources.entities, config.horizon_hours, config.prolonged_days
    )


def build_training(
    sources: Sources, cohort_ids: DataFrame | None = None, config: Config | None = None
) -> Training:
    """Index stays, labels and pruned features of a cohort, behind the guards.

    Index stays, labels and the long features are written once and read back:
    the slices, the profile and the pruned output all start from them.
    """
    config = config or Config()
    tune(sources.stays.sparkSession)
    first = settle(_index_stays(sources, cohort_ids, config))
    table = settle(_labels(sources, first, config))
    index = cohort.within_cohort(first, table)
    bundle = modality_bundle(sources, index, config)
    long = settle(feature_blocks(index, bundle, config))
    total = index.agg(F.count(F.lit(1))).scalar()
    members = settle(features.measured_members(long).distinct())
    profile = settle(prune.feature_profile(long, total, members))
    schema = settle(prune.kept_features(profile, config.min_support, config.top_k))
    names = schema_names(schema)
    if not names:
        raise prune.QualityError("pruning left no features")
    kept = long.join(schema.select("feature"), "feature", "left_semi")
    prune.assert_variable_fraction(
        prune.variable_fraction(kept, total, members=members), config.min_variable_fraction
    )
    prune.assert_parity(table, long)
    counts = features.modality_counts(
        {
            "index": first,
            "labelled": table,
            **{k: v for k, v in bundle.items() if k != "demo"},
        }
    )
    return Training(index, table, kept, schema, names, counts, members)


def training_rows(training: Training, seed: int = 42) -> DataFrame:
    """Wide features with labels and the shared split, joined by entity."""
    split = sampling.stratified_split(
        training.labels, "entity_id", TARGETS["readmission"], seed=seed
    )
    wide = features.to_wide(training.features, training.names, members=training.members)
    return features.join_labels(wide, split)


VECTOR = "vector"


def vector_rows(
    long: DataFrame, schema: DataFrame, entities: DataFrame, members: DataFrame | None = None
) -> DataFrame:
    """(entity_id, vector) of ``entities`` under a (feature, ordinal, median) schema."""
    cells = vectors.centred_cells(long, schema.select("feature", "median"), members)
    return vectors.sparse_vectors(cells, schema, entities, schema.count(), VECTOR)


def training_vectors(training: Training, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Labels, shared split and sparse feature vectors, and the schema they follow.

    Medians are those of the train split and part of the schema, so that scoring
    imputes alike.  A feature unknown there has the median 0.
    """
    split = settle(
        sampling.stratified_split(training.labels, "entity_id", TARGETS["readmission"], seed=seed)
    )
    train = split.filter(F.col("split") == "train").select("entity_id")
    medians = vectors.feature_medians(
        cohort.within_cohort(training.features, train), cohort.within_cohort(training.members, train)
    )
    schema = training.schema.select("feature", "ordinal").join(medians, "feature", "left")
    schema = settle(schema.select("feature", "ordinal", F.coalesce("median", F.lit(0.0)).alias("median")))
    rows = vector_rows(training.features, schema, split, training.members)
    return features.join_labels(rows, split), schema


def fit_all(
    rows: DataFrame,
    names: Sequence[str] | str = VECTOR,
    params: Mapping[str, Mapping[str, object]] | None = None,
    with_full: bool = False,
    seed: int = 42,
) -> dict[str, models.TargetModel]:
    """One calibrated model per target."""
    return {
        target: models.fit_target(
            rows, names, (params or {}).get(target), column, with_full, seed
        )
        for target, column in TARGETS.items()
    }


# --- scoring ---------------------------------------------------------------
def score_unseen(
    sources: Sources,
    cohort_ids: DataFrame | Sequence[int],
    fitted: Mapping[str, models.TargetModel],
    names: Sequence[str] | DataFrame,
    config: Config | None = None,
    require_labels: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Calibrated probabilities of the entities of a cohort, four fixed columns.

    ``names`` is the schema the models were fitted on: that of ``training_vectors``, or
    the column names of wide rows.  Features are aligned to it and never pruned, so a
    small batch keeps all its columns.  ``require_labels`` also applies the early-event
    exclusion, which looks at future data.
    """
    config = config or Config()
    spark = tune(sources.stays.sparkSession)
    if not isinstance(cohort_ids, DataFrame):
        if not cohort_ids:
            raise ValueError("no ids to score")
        cohort_ids = id_frame(spark, cohort_ids)
    index = _index_stays(sources, cohort_ids, config)
    if require_labels:
        index = cohort.within_cohort(index, _labels(sources, index, config))
    index = settle(index)
    long = feature_blocks(index, modality_bundle(sources, index, config), config)
    if isinstance(names, DataFrame):
        long = settle(long)
        members = settle(features.measured_members(long).distinct())
        known = long.join(names.select("feature"), "feature", "left_semi")
        total = index.agg(F.count(F.lit(1))).scalar()
        fraction = prune.variable_fraction(known, total, members=members).select(
            F.lit(names.count()).alias("n_features"), "n_variable"
        )
        fraction = fraction.withColumn("variable_fraction", F.col("n_variable") / F.col("n_features"))
        rows = vector_rows(long, names, index, members)
    else:
        rows = settle(features.to_wide(long, names))
        fraction = prune.wide_variable_fraction(rows)
    prune.assert_variable_fraction(fraction, config.min_scoring_fraction, strict)
    scored = models.score(rows, fitted, OUTPUTS)
    return features.final_columns(
        scored, ["mortality_proba", "prolonged_LOS_proba", "readmission_proba"]
    )
