import json

import pytest
from pyspark.sql import functions as F

from staylens.operators.prune import QualityError
from staylens.sources import files, tables
from tests.test_features import random_wide, wide_to_long


def test_lower_bind_defaults(frame):
    df = frame([(1, "2020-01-01 00:00:00")], "SubjectID bigint, ADMITTIME ts")
    low = tables.lower_columns(df)
    assert low.columns == ["subject_id", "admittime"]
    bound = tables.bind(df, {"subject_id": "entity_id", "deathtime": "deathtime"}, ["deathtime"])
    assert bound.columns == ["entity_id", "deathtime"] and bound.first()[1] is None
    with pytest.raises(QualityError):
        tables.bind(df, tables.STAYS)
    assert tables.with_defaults(low, {"age": 65}).first()["age"] == 65
    with pytest.raises(QualityError):
        tables.lower_columns(df.withColumn("subjectid2", F.lit(1)).toDF("A", "a", "b"))


def test_read_table(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    df = frame([(1, "2020-01-01 00:00:00")], "ID bigint, T ts").withColumn("T", F.col("T").cast("timestamp"))
    df.write.parquet(path)
    back = tables.read_table(spark, path, ["id", "t"])
    assert dict(back.dtypes)["t"] == "timestamp_ntz"
    with pytest.raises(QualityError):
        tables.read_table(spark, path, ["absent"])


def test_cohort_ids(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("SUBJECT_ID,x\n1,a\n2.0,b\n,c\njunk,d\n2,e\n")
    assert sorted(r[0] for r in tables.cohort_ids(spark, str(path)).collect()) == [1, 2]
    path.write_text("other\n1\n")
    with pytest.raises(QualityError):
        tables.cohort_ids(spark, str(path))
    assert tables.id_frame(spark, []).count() == 0


def test_labels_round_trip(spark, frame, tmp_path):
    labels = frame(
        [(1, 10, 0, 1, 0), (1, 11, 1, 1, 1), (2, 20, 0, 0, 1)],
        "entity_id bigint, stay_id bigint, mortality_label int, prolonged_los_label int, readmission_label int",
    )
    path = str(tmp_path / "labels")
    files.write_labels(labels, path)
    back = files.read_labels(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 10, 0, 1, 0), (2, 20, 0, 0, 1)]
    files.write_labels(labels.drop("stay_id"), path)
    with pytest.raises(QualityError):
        files.read_labels(spark, path)


def test_feature_artifacts(spark, tmp_path):
    long = wide_to_long(spark, random_wide())
    path = str(tmp_path / "art")
    files.write_features(long, 60, path, raw=long, with_health=True)
    assert spark.read.parquet(f"{path}/features").count() == long.count()
    assert spark.read.parquet(f"{path}/features_raw").count() == long.count()
    assert spark.read.json(f"{path}/health").count() == 6
    assert spark.read.json(f"{path}/provenance").count() == 7
    with pytest.raises(QualityError):
        files.write_features(long.filter("feature like 'constant%'"), 60, path)


def test_wide_and_schema(spark, frame, tmp_path):
    wide = frame([(1, 0.5), (2, None)], "entity_id bigint, f double")
    files.write_wide(wide, str(tmp_path / "w"))
    assert files.read_features(spark, str(tmp_path / "w")).count() == 2
    files.write_wide(wide.unionByName(wide), str(tmp_path / "w"))
    with pytest.raises(QualityError):
        files.read_features(spark, str(tmp_path / "w"))
    schema = frame([(1, "b"), (0, "a")], "ordinal bigint, feature string")
    files.write_schema(schema, str(tmp_path / "s"))
    assert files.schema_names(files.read_schema(spark, str(tmp_path / "s"))) == ["a", "b"]


def test_split_sources(spark, frame, tmp_path):
    split = frame(
        [(1, "train"), (2, "test"), (3, "test"), (4, "val")], "entity_id bigint, split string"
    )
    labels = frame([(1,), (2,), (4,)], "entity_id bigint")
    path = str(tmp_path / "split")
    files.write_split(split, path, 42)
    counts = spark.read.json(f"{path}/manifest").first()["counts"].asDict()
    assert counts == {"train": 1, "test": 2, "val": 1, "total": 4}
    got = files.read_split_ids(spark, [f"{path}/absent", f"{path}/ids_text/split=test"], labels)
    assert [r[0] for r in got.collect()] == [2]  # id 3 has no label

    nested = tmp_path / "nested.json"
    nested.write_text(json.dumps({"subject_ids": {"test": [2, 4, "x"]}}))
    legacy = tmp_path / "legacy.json"
    legacy.write_text(json.dumps({"test_ids": [1]}))
    read = lambda *c: sorted(
        r[0] for r in files.read_split_ids(spark, [str(x) for x in c], labels).collect()
    )
    assert read(nested) == [2, 4]
    assert read(legacy) == [1]
    text = tmp_path / "ids.txt"
    text.write_text("1\n nope\n 4 \n")
    assert read(nested, text) == [1, 4]  # text comes first
    with pytest.raises(QualityError):
        read(tmp_path / "nothing.json")
    files.write_nested_split(split, str(tmp_path / "n"), 42)
    doc = spark.read.json(str(tmp_path / "n")).first()
    assert sorted(doc["subject_ids"]["test"]) == [2, 3]


def test_metric_tables(spark, frame, tmp_path):
    table = frame([("a", 0.5)], "target string, auc double")
    for fmt in ("csv", "json"):
        files.write_metrics(table, str(tmp_path / fmt), fmt)
        back = files.read_metrics(spark, str(tmp_path / "none"), str(tmp_path / fmt), fmt)
        assert back.first()["auc"] == 0.5
    with pytest.raises(QualityError):
        files.read_metrics(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.write_metrics(table, str(tmp_path / "x"), "xml")


def test_chunked_split(spark, tmp_path):
    """Ten million ids come back, and no row of the files is above a megabyte."""
    n, path = 10**7, str(tmp_path / "chunks")
    split = spark.range(n).select(
        F.col("id").alias("entity_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split")
    )
    files.write_chunked_split(split, path, 42)
    lines = spark.read.text(f"{path}/chunks")
    assert lines.agg(F.max(F.length("value"))).first()[0] < 1_000_000 and lines.count() >= n // files.CHUNK_IDS
    ids = files.read_chunked_split(spark, path, "test")
    row = ids.agg(F.count("*"), F.sum("entity_id"), F.max(F.col("entity_id") % 5)).first()
    assert tuple(row) == (n // 5, sum(range(0, n, 5)), 0)
    rows = spark.range(20).withColumnRenamed("id", "entity_id")
    assert sorted(r[0] for r in files.read_chunked_split(spark, path, "test", rows).collect()) == [0, 5, 10, 15]


def test_chunked_split_is_checked(spark, frame, tmp_path):
    path = str(tmp_path / "c")
    split = frame([(i, "test" if i % 2 else "val") for i in range(50)], "entity_id bigint, split string")
    files.write_chunked_split(split, path, 1, chunk=7)
    with pytest.raises(QualityError):
        files.read_chunked_split(spark, path, "train")
    with pytest.raises(QualityError):
        files.read_chunked_split(spark, str(tmp_path / "nothing"))
    one = next((tmp_path / "c" / "chunks" / "split=test").glob("*.json"))
    lines = one.read_text().splitlines()
    one.write_text("\n".join([lines[0].replace('"ids":[', '"ids":[1000,'), *lines[1:]]) + "\n")
    (one.parent / f".{one.name}.crc").unlink()
    with pytest.raises(QualityError):
        files.read_chunked_split(spark, path, "test")
    assert files.read_chunked_split(spark, path, "val").count() == 25
