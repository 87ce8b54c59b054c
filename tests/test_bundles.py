"""Saving and loading fitted targets."""

import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import models, vectors
from staylens.sources import bundles

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    long, labels = [], []
    for e in range(150):
        y = int(rng.random() < 0.4)
        labels.append((e, y, 1 - y, ("train", "val", "test")[e % 3]))
        long += [(e, f, rng.gauss(y, 1.0)) for f in FEATURES if rng.random() < 0.8]
    cells = spark.createDataFrame(long, "entity_id bigint, feature string, value double")
    medians = vectors.feature_medians(cells)
    schema = medians.withColumn("ordinal", F.ascii("feature") - 97).cache()
    labels = spark.createDataFrame(labels, "entity_id bigint, y int, z int, split string")
    centred = vectors.centred_cells(cells, medians)
    rows = vectors.sparse_vectors(centred, schema, labels, 3).join(labels, "entity_id").cache()
    small = {"maxIter": 3, "maxDepth": 2}
    made = {t: models.fit_target(rows, "vector", small, t, with_full=t == "y") for t in ("y", "z")}
    made["plain"] = models.TargetModel(models.baseline_logistic(rows, "vector"), None, None, 0.5)
    return rows, schema, made


def scores(rows, made):
    got = models.score(rows, made).orderBy("entity_id").collect()
    return [tuple(round(v, 12) for v in r) for r in got]


def test_a_new_session_scores_alike(fitted, spark, tmp_path):
    rows, schema, made = fitted
    path = str(tmp_path / "store")
    assert bundles.versions(spark, path) == []
    assert bundles.save(path, made, schema) == 1
    other = spark.newSession()
    loaded = bundles.load(other, path, expected=schema)
    assert loaded.version == 1 and set(loaded.models) == {"y", "z", "plain"}
    assert loaded.models["z"].full is None and loaded.models["y"].full is not None
    assert loaded.models["y"].threshold == made["y"].threshold
    assert scores(rows, loaded.models) == scores(rows, made)
    assert sorted(map(tuple, loaded.schema.collect())) == sorted(
        (r["feature"], r["ordinal"], r["median"]) for r in schema.collect()
    )


def test_versions_and_refusals(fitted, spark, tmp_path):
    rows, schema, made = fitted
    path = str(tmp_path / "store")
    one = {"plain": made["plain"]}
    assert [bundles.save(path, one, schema) for _ in range(2)] == [1, 2]
    assert bundles.load(spark, path).version == 2 and bundles.load(spark, path, 1).version == 1
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, path, 7)
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, str(tmp_path / "nothing"))
    moved = schema.withColumn("ordinal", 2 - F.col("ordinal"))
    with pytest.raises(bundles.SchemaMismatch):
        bundles.load(spark, path, expected=moved)
    moved.select("feature", F.col("ordinal").cast("int").alias("ordinal"), "median").write.mode(
        "overwrite"
    ).parquet(f"{path}/version=2/schema")
    with pytest.raises(bundles.SchemaMismatch):
        bundles.load(spark, path)
    assert bundles.load(spark, path, 1).version == 1


def test_unfinished_versions_are_not_seen(fitted, spark, tmp_path):
    _, schema, made = fitted
    path = str(tmp_path / "store")
    bundles.save(path, {"plain": made["plain"]}, schema)
    schema.write.parquet(f"{path}/version=2/schema")  # stopped before its manifest
    assert bundles.load(spark, path).version == 1
    assert bundles.save(path, {"plain": made["plain"]}, schema) == 2
