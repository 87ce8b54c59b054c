"""Sparse feature vectors and importances straight from long rows.

A feature matrix with imputed medians is dense, but the same matrix less the medians is
not: a missing cell is 0 there.  Linear models and tree splits do not mind the shift, so
fits and importances work on *centred cells* (entity_id, feature, value - median), and no
column per feature is ever planned.

The implied zeros of a ``measured`` feature are cells too.  They are written out only where
the median is not zero; at least half of the members have a stored cell then, so there are
never more of them than stored ones.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from staylens.operators.features import measured_members
from staylens.operators.ranking import exact_quantiles
from staylens.session import scratch, settle


def _measured(long: DataFrame) -> DataFrame:
    return long.filter(F.col("stat") == "measured")


def feature_medians(long: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(feature, median) of the known cells, implied zeros included.

    A ``measured`` feature holds ones and implied zeros, so its median follows from the
    two numbers; the others are exact interpolated quantiles.
    """
    if "stat" not in long.columns:
        return exact_quantiles(long, "value", [0.5], ["feature"]).select(
            "feature", F.col("value").alias("median")
        )
    plain = long.filter(F.col("stat").isNull() | (F.col("stat") != "measured"))
    plain = exact_quantiles(plain, "value", [0.5], ["feature"]).select(
        "feature", F.col("value").alias("median")
    )
    inside = measured_members(long, members).distinct()
    sizes = inside.groupBy("modality").agg(F.count(F.lit(1)).alias("m"))
    ones = _measured(long).groupBy("modality", "feature").agg(F.count(F.lit(1)).alias("n"))
    half = F.when(2 * F.col("n") > F.col("m"), 1.0).when(2 * F.col("n") == F.col("m"), 0.5)
    flags = ones.join(sizes, "modality").select("feature", half.otherwise(0.0).alias("median"))
    return plain.unionByName(flags)


def centred_cells(
    long: DataFrame, medians: DataFrame, members: DataFrame | None = None
) -> DataFrame:
    """(entity_id, feature, value) less the feature's median, zeros left out.

    Features without a median are no part of the schema and are dropped.
    """
    value = F.col("value").cast("double") - F.col("median")
    cells = long.join(medians, "feature").select("entity_id", "feature", value.alias("value"))
    if "stat" in long.columns:
        raised = _measured(long).select("modality", "feature").distinct()
        raised = raised.join(medians.filter(F.col("median") != 0), "feature")
        inside = measured_members(long, members).distinct()
        implied = inside.join(raised, "modality").join(
            _measured(long).select("entity_id", "feature"), ["entity_id", "feature"], "left_anti"
        )
        cells = cells.unionByName(
            implied.select("entity_id", "feature", (-F.col("median")).alias("value"))
        )
    return cells.filter(F.col("value") != 0)


def sparse_rows(cells: DataFrame, schema: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, indices, values) in the order of ``schema`` (feature, ordinal).

    Every entity has a row, cells outside the schema are left out.
    """
    placed = cells.join(
        schema.select("feature", F.col("ordinal").cast("int").alias("at")), "feature"
    )
    packed = placed.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells")
    )
    none = F.array().cast("array<struct<at:int,value:double>>")
    rows = entities.select("entity_id").distinct().join(packed, "entity_id", "left")
    return rows.select("entity_id", F.coalesce("cells", none).alias("cells")).select(
        "entity_id", F.col("cells.at").alias("indices"), F.col("cells.value").alias("values")
    )


def sparse_vectors(
    cells: DataFrame, schema: DataFrame, entities: DataFrame, size: int, name: str = "vector"
) -> DataFrame:
    """(entity_id, vector) for Spark ML, ``size`` wide.

    The vector type is stored as a plain structure in Parquet, so writing the structure
    and reading it as vectors needs no function over the rows.
    """
    spark = cells.sparkSession
    rows = sparse_rows(cells, schema, entities).select(
        "entity_id",
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(int(size)).alias("size"),
            F.col("indices").alias("indices"),
            F.col("values").alias("values"),
        ).alias(name),
    )
    path = scratch(spark)
    rows.write.parquet(path)
    kind = StructType([rows.schema["entity_id"], StructField(name, VectorUDT())])
    return spark.read.schema(kind).parquet(path)


def linear_contributions(cells: DataFrame, weights: DataFrame, total: Column | int) -> DataFrame:
    """w * (x - mean) of a linear model over ``total`` entities, cells as above.

    One row per stored cell, and per feature one row with entity_id NULL: what each of the
    ``n_cells`` entities without a stored cell gets.
    """
    size = total if isinstance(total, Column) else F.lit(total)
    size = size.cast("long")
    sums = settle(
        weights.join(
            cells.groupBy("feature").agg(
                F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")
            ),
            "feature",
            "left",
        ).select(
            "feature",
            F.col("weight").cast("double").alias("weight"),
            F.coalesce(F.col("s") / size, F.lit(0.0)).alias("mean"),
            (size - F.coalesce("n", F.lit(0))).alias("rest"),
        )
    )
    stored = cells.join(sums, "feature").select(
        "entity_id",
        "feature",
        (F.col("weight") * (F.col("value") - F.col("mean"))).alias("contribution"),
        F.lit(1).cast("long").alias("n_cells"),
    )
    others = sums.select(
        F.lit(None).cast(cells.schema["entity_id"].dataType).alias("entity_id"),
        "feature",
        (-F.col("weight") * F.col("mean")).alias("contribution"),
        F.col("rest").alias("n_cells"),
    )
    return stored.unionByName(others.filter(F.col("n_cells") > 0))


def mean_abs_contribution(contributions: DataFrame, top_k: int | None = None) -> DataFrame:
    """Global importance: mean absolute contribution over all entities, largest first."""
    share = F.sum(F.abs("contribution") * F.col("n_cells")) / F.sum("n_cells")
    out = contributions.groupBy("feature").agg(share.alias("mean_abs_contribution"))
    ordered = out.orderBy(F.col("mean_abs_contribution").desc(), "feature")
    return ordered if top_k is None else ordered.limit(top_k)
