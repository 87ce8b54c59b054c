"""A versioned store of fitted targets.

A bundle is what scoring needs: the feature schema with its medians, and per target the
models, the calibration steps and the threshold.  Everything lies under
``version=<n>``; a row in ``manifests`` is written last, so a bundle without one was never
finished.  Loading refuses a bundle whose schema differs from the manifest's fingerprint,
or from the schema the caller expects.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.models import TargetModel
from staylens.operators.prune import QualityError

FORMAT = 1
MANIFEST = "format int, version int, fingerprint string, n_features long"
TARGET = "target string, threshold double, has_base boolean, has_full boolean, has_steps boolean"


class SchemaMismatch(QualityError):
    """A bundle's schema is not the one it was saved with, or not the one wanted."""


@dataclass
class Bundle:
    """Models by target and the (feature, ordinal, median) schema they read."""

    models: dict[str, TargetModel]
    schema: DataFrame
    version: int
    fingerprint: str


def fingerprint(schema: DataFrame) -> str:
    """Names and positions of a schema as one text; a sum over its rows, in any order."""
    place = F.xxhash64(F.col("feature"), F.col("ordinal").cast("long"))
    row = schema.agg(
        F.count(F.lit(1)).alias("n"), F.sum(place.cast("decimal(38,0)")).alias("h")
    ).first()
    return f"{row['n']}:{row['h'] or 0}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{path}/manifests").select("version").collect()
    except AnalysisException:  # nothing saved yet
        return []
    return sorted(r["version"] for r in found)  # one row per save


def save(path: str, models: Mapping[str, TargetModel], schema: DataFrame) -> int:
    """Write a new version under ``path`` and return its number."""
    spark = schema.sparkSession
    version = max(versions(spark, path), default=0) + 1
    root = f"{path}/version={version}"
    schema.select("feature", F.col("ordinal").cast("int").alias("ordinal"), "median").write.mode(
        "overwrite"
    ).parquet(f"{root}/schema")
    targets = []
    for target, model in models.items():
        for name, fitted in (("base", model.base), ("full", model.full)):
            if fitted is not None:
                fitted.write().overwrite().save(f"{root}/{target}/{name}")
        if model.calibrator is not None:
            model.calibrator.write.mode("overwrite").parquet(f"{root}/{target}/steps")
        kinds = [part is not None for part in (model.base, model.full, model.calibrator)]
        targets.append((target, float(model.threshold), *kinds))
    spark.createDataFrame(targets, TARGET).coalesce(1).write.mode("overwrite").json(f"{root}/targets")
    mark = fingerprint(schema)
    row = [(FORMAT, version, mark, int(mark.split(":")[0]))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


def load(
    spark: SparkSession, path: str, version: int | None = None, expected: DataFrame | None = None
) -> Bundle:
    """The newest or a given version."""
    known = versions(spark, path)
    chosen = version if version is not None else max(known, default=None)
    if chosen is None or chosen not in known:
        raise FileNotFoundError(f"no finished bundle {chosen or ''} under {path}")
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifests").filter(F.col("version") == chosen)
    manifest = manifest.first()
    if manifest["format"] != FORMAT:
        raise SchemaMismatch(f"format {manifest['format']} is not {FORMAT}")
    root = f"{path}/version={chosen}"
    schema = spark.read.schema("feature string, ordinal int, median double").parquet(f"{root}/schema")
    if fingerprint(schema) != manifest["fingerprint"]:
        raise SchemaMismatch(f"the schema of version {chosen} was changed after it was saved")
    if expected is not None and fingerprint(expected) != manifest["fingerprint"]:
        raise SchemaMismatch(f"version {chosen} was fitted on other features")
    models = {}
    for row in spark.read.schema(TARGET).json(f"{root}/targets").collect():  # one per target
        folder = f"{root}/{row['target']}"
        try:
            models[row["target"]] = TargetModel(
                PipelineModel.load(f"{folder}/base") if row["has_base"] else None,
                PipelineModel.load(f"{folder}/full") if row["has_full"] else None,
                spark.read.parquet(f"{folder}/steps") if row["has_steps"] else None,
                row["threshold"],
            )
        except (AnalysisException, Py4JJavaError) as lost:
            raise FileNotFoundError(f"version {chosen} lacks a part of {row['target']}") from lost
    return Bundle(models, schema, chosen, manifest["fingerprint"])
