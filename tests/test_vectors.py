"""Sparse vectors and closed-form importances against the dense matrix."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staylens.operators import explain, features, models, vectors
from staylens.operators.metrics import roc_auc

LONG = "entity_id bigint, modality string, label string, stat string, feature string, value double"


def long_rows(n=60, seed=2):
    """Measured features of two modalities, one mostly present, and plain ones with gaps."""
    rng = random.Random(seed)
    rows = []
    for e in range(n):
        for label, share in (("often", 0.8), ("half", 0.5), ("rare", 0.2)):
            if e % 5 and rng.random() < share:
                rows.append((e, "v", label, "measured", f"v:{label}__measured", 1.0))
                rows.append((e, "v", label, "mean", f"v:{label}__mean", float(rng.randrange(6))))
        rows.append((e, "cal", None, None, "admit_month", float(e % 12)))
    return rows


def dense(rows):
    """(matrix {entity: {feature: value}}, medians), implied zeros and medians filled in."""
    members = {r[0] for r in rows if r[3] == "measured"}
    names = sorted({r[4] for r in rows})
    table = {e: {} for e in sorted({r[0] for r in rows})}
    for e, _, _, _, f, v in rows:
        table[e][f] = v
    for f in names:
        if f.endswith("__measured"):
            for e in members:
                table[e].setdefault(f, 0.0)
    medians = {f: statistics.median([t[f] for t in table.values() if f in t]) for f in names}
    return {e: {f: t.get(f, medians[f]) for f in names} for e, t in table.items()}, medians


@pytest.fixture(scope="module")
def prepared(spark):
    rows = long_rows()
    long = spark.createDataFrame(rows, LONG).cache()
    medians = vectors.feature_medians(long).cache()
    return rows, long, medians


def test_medians(prepared):
    rows, _, medians = prepared
    assert {r["feature"]: r["median"] for r in medians.collect()} == dense(rows)[1]


def test_vectors_are_the_dense_matrix_less_the_medians(prepared):
    rows, long, medians = prepared
    wanted, middle = dense(rows)
    names = sorted(middle)
    schema = medians.select("feature").withColumn(
        "ordinal", F.array_position(F.array(*[F.lit(f) for f in names]), F.col("feature")) - 1
    )
    cells = vectors.centred_cells(long, medians)
    out = vectors.sparse_vectors(cells, schema, long, len(names)).collect()
    assert len(out) == len(wanted)
    for row in out:
        assert row["vector"].size == len(names)
        got = dict(zip(names, row["vector"].toArray().tolist()))
        assert got == {f: v - middle[f] for f, v in wanted[row["entity_id"]].items()}
    # Implied cells are written only for features with a median above zero.
    stored = {r["feature"] for r in cells.filter("value < 0").collect() if r["feature"].endswith("measured")}
    assert stored == {f for f in names if f.endswith("__measured") and middle[f] > 0}


def test_members_outlive_pruning(prepared, spark):
    _, long, _ = prepared
    members = features.measured_members(long).distinct()
    kept = long.filter("feature in ('v:often__measured', 'admit_month')")
    lost = kept.filter("feature = 'v:often__measured'")
    whole = vectors.feature_medians(long).filter("feature = 'v:often__measured'").first()["median"]
    assert vectors.feature_medians(lost, members).first()["median"] == whole


def test_importance_counts_cells_that_are_not_stored(prepared, spark):
    rows, long, medians = prepared
    matrix, middle = dense(rows)
    weight = {f: 1.5 - i for i, f in enumerate(sorted(middle))}
    table = spark.createDataFrame(list(weight.items()), "feature string, weight double")
    parts = vectors.linear_contributions(vectors.centred_cells(long, medians), table, len(matrix))
    got = {r[0]: r[1] for r in vectors.mean_abs_contribution(parts).collect()}
    for f in middle:
        column = np.array([m[f] for m in matrix.values()])
        assert got[f] == pytest.approx(np.abs(weight[f] * (column - column.mean())).mean())
    assert got["v:half__measured"] > 0  # was 0 while only ones were seen
    top = vectors.mean_abs_contribution(parts, 2).collect()
    assert [r[0] for r in top] == sorted(got, key=lambda f: (-got[f], f))[:2]


def test_importance_of_a_fitted_model(prepared, spark):
    rows, long, medians = prepared
    matrix, middle = dense(rows)
    names = sorted(middle)
    schema = spark.createDataFrame([(f, i, middle[f]) for i, f in enumerate(names)], "feature string, ordinal int, median double")
    cells = vectors.centred_cells(long, medians)
    wide = spark.createDataFrame(
        [(e, int(m["admit_month"] > 5), *[m[f] for f in names]) for e, m in matrix.items()],
        "entity_id bigint, y int, " + ", ".join(f"`{f}` double" for f in names),
    )
    sparse = vectors.sparse_vectors(cells, schema, long, len(names)).join(wide.select("entity_id", "y"), "entity_id")
    noisy = lambda df: df.withColumn("y", F.when(F.col("entity_id") % 7 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    a = models.baseline_logistic(noisy(sparse), "vector")
    z = models.baseline_logistic(noisy(wide), names)
    first = {r["entity_id"]: r["p"] for r in models.predict(a, sparse).collect()}
    other = {r["entity_id"]: r["p"] for r in models.predict(z, wide).collect()}
    assert all(first[e] == pytest.approx(other[e], abs=1e-4) for e in matrix)
    weights = models.logistic_weights(a, names, spark)
    parts = vectors.linear_contributions(cells, weights, len(matrix))
    got = {r[0]: r[1] for r in vectors.mean_abs_contribution(parts).collect()}
    for f, w in {r["feature"]: r["weight"] for r in weights.collect()}.items():
        column = np.array([m[f] for m in matrix.values()])
        assert got[f] == pytest.approx(np.abs(w * (column - column.mean())).mean())


def test_many_features_plan_quickly(spark):
    """2,000 features are rows, not columns."""
    n = 2000
    long = spark.range(300).select(
        F.col("id").alias("entity_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(37))).alias("f")
    ).withColumn("feature", F.concat(F.lit("m:"), (F.col("f") + F.col("entity_id") % 37).cast("string")))
    long = long.select("entity_id", "feature", (F.hash("entity_id", "f") % 100).cast("double").alias("value"))
    schema = spark.range(n).select(
        F.concat(F.lit("m:"), F.col("id").cast("string")).alias("feature"), F.col("id").cast("int").alias("ordinal")
    )
    rows = vectors.sparse_vectors(long.filter("value != 0"), schema, long, n)
    rows = rows.withColumn("y", (F.col("entity_id") % 2).cast("int"))
    begin = time.time()
    models.baseline_logistic(rows, "vector", max_iter=5)
    assert time.time() - begin < 30


def test_one_permutation_serves_all_features(spark):
    rng = random.Random(9)
    data = [(i, int(rng.random() < 0.4), float(rng.randrange(20)), float(rng.randrange(5))) for i in range(90)]
    df = spark.createDataFrame(data, "entity_id bigint, y int, `m:a.1` double, b double")
    score = lambda d: d.withColumn("p", F.col("`m:a.1`") + 2 * F.col("b"))
    got = {r["feature"]: r for r in explain.permutation_importance(df, ["m:a.1", "b"], score).collect()}
    import hashlib

    def order(seed):
        h = lambda i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16)
        return sorted(range(90), key=lambda i: (h(i), i))

    donor = dict(zip(order(42), order(43)))
    for at, name in ((2, "m:a.1"), (3, "b")):
        mixed = [list(r) for r in data]
        for i, row in enumerate(mixed):
            row[at] = data[donor[i]][at]
        frame = spark.createDataFrame([(r[1], r[2] + 2 * r[3]) for r in mixed], "y int, p double")
        assert got[name]["shuffled_auc"] == pytest.approx(roc_auc(frame).first()["auc"])


def test_vector_type_survives_parquet(spark, tmp_path):
    cells = spark.createDataFrame([(1, "b", 2.5)], "entity_id bigint, feature string, value double")
    schema = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, ordinal int")
    entities = spark.createDataFrame([(1,), (2,)], "entity_id bigint")
    out = vectors.sparse_vectors(cells, schema, entities, 3)
    got = {r[0]: r[1] for r in out.select("entity_id", vector_to_array("vector")).collect()}
    assert got == {1: [0.0, 2.5, 0.0], 2: [0.0, 0.0, 0.0]}
