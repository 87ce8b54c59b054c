"""Inputs that must fail loudly, and widths that must not."""

import pytest
from pyspark.sql import functions as F

from staylens.operators import features, prune, sampling


def test_scoring_guard_at_full_width(spark):
    wide = spark.range(3).select(
        F.col("id").alias("entity_id"),
        *[(F.col("id") * (i % 2)).cast("double").alias(f"f{i}") for i in range(2000)],
    )
    row = prune.wide_variable_fraction(wide).first()
    assert (row["n_features"], row["n_variable"], row["variable_fraction"]) == (2000, 1000, 0.5)


def test_labelled_entities_need_features(spark):
    some = spark.createDataFrame([(1, 0.5)], "entity_id long, x double")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "entity_id long, y int")
    with pytest.raises(ValueError, match="1 labelled"):
        features.join_labels(some, labels)
    assert features.join_labels(some, labels, strict=False).count() == 1


def test_null_strata_are_an_error(spark):
    df = spark.createDataFrame([(i, None if i == 7 else i % 2) for i in range(40)], "k long, y int")
    with pytest.raises(ValueError, match="NULL"):
        sampling.hash_slices(df, "k", 1, lambda n: [n / 2], strata=["y"])
