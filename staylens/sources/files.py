"""Readers and writers of labels, features, schemas, splits and metric tables.

Writers use Spark's own sinks, so every executor writes its part and outputs
are directories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staylens.operators import cohort
from staylens.operators.features import provenance
from staylens.operators.labels import LABELS
from staylens.operators.prune import (
    QualityError,
    assert_unique_ids,
    assert_variable_fraction,
    health_profile,
    require_columns,
    variable_fraction,
)
from staylens.session import settle

SPLITS = ("train", "val", "test")
MIN_PERSIST_FRACTION = 0.5
SCHEMA_ROWS = 1 << 16  # features in a file of a schema
CHUNK_IDS = 1 << 15  # ids in a chunk: at most 20 digits and a comma each, so below a megabyte


# --- labels ----------------------------------------------------------------
def write_labels(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label table as CSV with a header."""
    labels.write.mode(mode).csv(path, header=True)


def read_labels(spark: SparkSession, path: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Label table from CSV: required columns, one row per entity, whole numbers."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, ["entity_id", "stay_id", *labels], path)
    typed = raw.select(
        F.col("entity_id").cast("long"),
        F.col("stay_id").cast("long"),
        *[F.col(c).cast("int") for c in labels],
    ).filter(F.col("entity_id").isNotNull())
    return cohort.one_per_entity(typed, "entity_id", ["stay_id"])


# --- features --------------------------------------------------------------
def write_features(
    long: DataFrame,
    n_entities: int,
    path: str,
    raw: DataFrame | None = None,
    with_health: bool = False,
    minimum: float = MIN_PERSIST_FRACTION,
    mode: str = "overwrite",
    members: DataFrame | None = None,
    schema: DataFrame | None = None,
) -> None:
    """Persist pruned features, schema and provenance behind the variability guard.

    ``members`` (of the unpruned features) and the ordered ``schema`` are written
    with them when given; ``raw`` (before pruning) and the health profile on request.
    """
    fraction = variable_fraction(long, n_entities, members=members)
    assert_variable_fraction(fraction, minimum)
    long.write.mode(mode).parquet(f"{path}/features")
    if members is not None:
        members.distinct().write.mode(mode).parquet(f"{path}/members")
    if schema is not None:
        write_schema(schema, f"{path}/schema", mode)
    if raw is not None:
        raw.write.mode(mode).parquet(f"{path}/features_raw")
    if with_health:
        health_profile(long, n_entities, members=members).write.mode(mode).json(f"{path}/health")
    provenance(long).write.mode(mode).json(f"{path}/provenance")


def write_wide(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Wide feature matrix as Parquet."""
    wide.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Wide feature matrix; ids must be unique whole numbers."""
    wide = spark.read.parquet(path)
    require_columns(wide, ["entity_id"], path)
    assert_unique_ids(wide)
    return wide.withColumn("entity_id", F.col("entity_id").cast("long"))


def write_schema(schema: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(ordinal, feature) as JSON lines; the ordinal carries the column order."""
    rows = schema.select("ordinal", "feature")
    parts = max(1, -(-rows.count() // SCHEMA_ROWS))
    rows.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal").write.mode(mode).json(path)


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal bigint, feature string").json(path)


def schema_names(schema: DataFrame) -> list[str]:
    """Feature names in schema order, for wide forms: their columns are in the plan anyway."""
    return [r["feature"] for r in schema.orderBy("ordinal").select("feature").collect()]


# --- splits ----------------------------------------------------------------
def write_split(split: DataFrame, path: str, seed: int, mode: str = "overwrite") -> None:
    """Split ids as JSON parts, one-id-per-line text, and a counts manifest."""
    ids = split.select("split", F.col("entity_id").cast("long"))
    ids.write.mode(mode).partitionBy("split").json(f"{path}/ids_json")
    ids.select("split", F.col("entity_id").cast("string").alias("value")).write.mode(
        mode
    ).partitionBy("split").text(f"{path}/ids_text")
    counts = ids.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("split"), "n")
    named = counts.unionByName(total)
    manifest = named.agg(
        F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("counts")
    ).select(
        F.current_timestamp().alias("created_utc"), F.lit(seed).alias("seed"), "counts"
    )
    manifest.write.mode(mode).json(f"{path}/manifest")


def write_nested_split(split: DataFrame, path: str, seed: int, mode: str = "overwrite") -> None:
    """The manifest as one nested document, for consumers that expect it.

    It holds every id in one row by definition of the format; use
    ``write_split`` or ``write_chunked_split`` for large cohorts.
    """
    ids = split.groupBy("split").agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    lists = F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("subject_ids")
    sizes = F.map_from_entries(F.collect_list(F.struct("split", F.size("ids"))))
    ids.agg(lists, sizes.alias("counts")).withColumn("seed", F.lit(seed)).write.mode(mode).json(
        path
    )


def _checksum() -> Column:
    return F.coalesce(F.bit_xor(F.xxhash64("entity_id")), F.lit(0).cast("long")).alias("checksum")


def write_chunked_split(
    split: DataFrame, path: str, seed: int, chunk: int = CHUNK_IDS, mode: str = "overwrite"
) -> None:
    """The ids of every split as ranged chunks, each with its count, ends and checksum.

    A chunk holds ``chunk`` ids at most, ascending, and no other chunk of its split has an
    id between its ends.  The manifest, written last, holds counts and checksums per split.
    """
    ids = settle(split.select("split", F.col("entity_id").cast("long").alias("entity_id")).distinct())
    parts = max(1, -(-ids.count() // (8 * chunk)))
    dealt = ids.repartitionByRange(parts, "split", "entity_id").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("split", "part").orderBy("entity_id")) - 1
    chunks = (
        dealt.withColumn("chunk", F.floor(place / chunk))
        .groupBy("split", "part", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("entity_id").alias("low"),
            F.max("entity_id").alias("high"),
            _checksum().alias("checksum"),
            F.sort_array(F.collect_list("entity_id")).alias("ids"),
        )
    )
    chunks.write.mode(mode).partitionBy("split").json(f"{path}/chunks")
    whole = ids.groupBy("split").agg(F.count(F.lit(1)).alias("n"), _checksum().alias("checksum"))
    manifest = whole.select("split", "n", "checksum", F.lit(seed).alias("seed"), F.lit(chunk).alias("chunk"))
    manifest.coalesce(1).write.mode(mode).json(f"{path}/manifest")


def read_chunked_split(
    spark: SparkSession, path: str, split: str = "test", rows: DataFrame | None = None
) -> DataFrame:
    """Ids of a split, checked against chunk and manifest; with ``rows``, their semi join."""
    try:
        manifest = spark.read.schema("split string, n long, checksum long").json(f"{path}/manifest")
        chunks = spark.read.schema(
            "n long, low long, high long, checksum long, ids array<long>, split string"
        ).json(f"{path}/chunks").filter(F.col("split") == split)
    except AnalysisException as problem:
        raise QualityError(f"no finished split manifest at {path}") from problem
    wanted = manifest.filter(F.col("split") == split).first()
    if wanted is None:
        raise QualityError(f"the manifest at {path} has no split {split}")
    ids = chunks.select(F.explode("ids").alias("entity_id"))
    found = ids.agg(F.count(F.lit(1)).alias("n"), _checksum().alias("checksum")).first()
    bad = chunks.filter(
        (F.size("ids") != F.col("n")) | (F.array_min("ids") != F.col("low")) | (F.array_max("ids") != F.col("high"))
        | (F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(F.xxhash64(i))) != F.col("checksum"))
    )
    if (found["n"], found["checksum"]) != (wanted["n"], wanted["checksum"]) or not bad.isEmpty():
        raise QualityError(f"the ids of split {split} at {path} are not those of the manifest")
    return ids if rows is None else rows.join(ids, "entity_id", "left_semi")


def _text_ids(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).filter(line.rlike(r"^\d+$")).select(
        line.cast("long").alias("entity_id")
    )


def _json_ids(spark: SparkSession, path: str, split: str) -> DataFrame | None:
    doc = spark.read.option("multiLine", "true").json(path)
    nested = doc.schema["subject_ids"].dataType if "subject_ids" in doc.columns else None
    field = None
    if isinstance(nested, StructType) and split in nested.names:
        field = f"subject_ids.{split}"
    else:
        for name in (split, f"{split}_ids", f"{split}_subject_ids"):
            if name in doc.columns:
                field = name
                break
    if field is None:
        return None
    ids = doc.select(F.explode(field).alias("v")).select(F.col("v").cast("string").alias("v"))
    return ids.filter(F.col("v").rlike(r"^\d+$")).select(F.col("v").cast("long").alias("entity_id"))


def read_split_ids(
    spark: SparkSession, candidates: Sequence[str], labels: DataFrame, split: str = "test"
) -> DataFrame:
    """Ids of a split from the first usable source, restricted to labelled entities.

    Text sources come before JSON ones; a path that does not exist is skipped.
    """
    text_like = [c for c in candidates if not c.endswith(".json")]
    json_like = [c for c in candidates if c.endswith(".json")]
    for path, reader in [(p, _text_ids) for p in text_like] + [
        (p, lambda s, q: _json_ids(s, q, split)) for p in json_like
    ]:
        try:
            ids = reader(spark, path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" in str(problem):
                continue
            raise
        if ids is not None:
            return ids.distinct().join(labels.select("entity_id"), "entity_id", "left_semi")
    raise QualityError(f"no source of {split} ids among {list(candidates)}")


# --- metric tables ---------------------------------------------------------
def write_metrics(metrics: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Metric table as CSV with header, or JSON lines."""
    if fmt == "csv":
        metrics.write.mode(mode).csv(path, header=True)
    elif fmt == "json":
        metrics.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_metrics(
    spark: SparkSession, path: str, fallback: str | None = None, fmt: str = "csv"
) -> DataFrame:
    """Metric table; ``fallback`` is read when ``path`` does not exist.

    Metric tables are small, so the types of a CSV are inferred.
    """
    for candidate in [p for p in (path, fallback) if p]:
        try:
            if fmt == "csv":
                return spark.read.csv(candidate, header=True, inferSchema=True)
            return spark.read.json(candidate)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    raise QualityError(f"no metric table at {path}")
