"""Shapes of physical plans that matter at scale."""

from pyspark.sql import functions as F

from staylens.operators import features, prune, sampling, window
from staylens.plans import bindings as b
from staylens.plans import queries_models
from staylens.session import settle
from tests.test_features import random_wide, wide_to_long


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_do_not_shuffle_rows(spark, tmp_path):
    spark.range(2000).withColumn("y", F.col("id") % 2).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    text = plan(sampling.stratified_split(rows, "id", "y"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert "Exchange" not in plan(sampling.sample_n(rows, "id", 10)).split("Subquery")[0]


def test_event_statistics_hash_aggregate(spark, frame):
    df = frame(
        [(1, 1, "a", 1.0, "2020-01-01 00:00:00")],
        "entity_id bigint, event_id bigint, label string, value double, t ts",
    )
    text = plan(features.event_stats(df, max_labels=None))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_health_combines_on_the_map_side(spark):
    text = plan(prune.health_profile(wide_to_long(spark, random_wide()), 60))
    assert "HashAggregate" in text
    assert "Window" not in text and "SortAggregate" not in text


def test_window_bounds_reach_the_reader(spark, tmp_path, frame):
    events = frame([(1, "2020-01-01 00:00:00")], "stay_id bigint, t ts")
    index = settle(frame([(1, "2020-01-01 00:00:00")], "stay_id bigint, admit ts"))
    text = plan(window.early_window(settle(events), index, prune_scan=True))
    assert "GreaterThanOrEqual(t,2020-01-01T00:00" in text and "LessThan(t,2020-01-03T01:00" in text


def test_scope_removes_what_was_settled(spark, tmp_path):
    import os

    from staylens import session

    with session.scope(spark):
        outer = session.scratch(spark)
        with session.scope(spark):
            table = session.settle(spark.range(5))
            inner = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
            assert os.path.isdir(inner) and table.count() == 5
        assert not os.path.exists(inner)
        spark.range(3).write.parquet(outer)
        assert os.path.isdir(outer)
    assert not os.path.exists(outer)
    kept = session.settle(spark.range(2))
    assert kept.count() == 2


def test_ordinals_over_many_features(spark):
    from pyspark.sql import functions as F

    from staylens.operators import ranking

    n = 10**6
    names = spark.range(n).select(F.format_string("f%07d", (F.col("id") * 7919) % n).alias("feature"))
    out = ranking.ordinals(names, ["feature"])
    wrong = out.filter(F.substring("feature", 2, 7).cast("long") != F.col("ordinal"))
    assert out.count() == n and wrong.isEmpty()
    sizes = names.repartitionByRange(-(-n // ranking.ORDINALS), "feature").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 65_536
    assert ranking.ordinals(names.limit(0), ["feature"]).count() == 0


def test_build_sources_hold_lines_of_index_stays_once(spark):
    d = "/root/testdata/sf0.001"
    sources = queries_models.surrogate_sources(spark, d)
    first = b.first_stays(spark, d).select("stay_id")
    every = b.order_lines(spark, d).select("stay_id", "event_id", "t")
    wanted = every.join(first, "stay_id", "left_semi")
    for part in (sources.vitals, sources.labs):
        held = part.select("stay_id", "event_id", "t")
        assert held.exceptAll(wanted).isEmpty() and wanted.exceptAll(held).isEmpty()
    assert sources.rx.count() == sources.proc.count() == wanted.count() < every.count()
    # no build scans the line table again
    assert all("lineitem" not in plan(p) for p in (sources.vitals, sources.labs, sources.rx, sources.proc))


def test_text_features_are_made_for_labelled_documents_only(spark, tmp_path):
    texts = ["a B7 9\ncé 🙂X", "", None, "unlabelled 1"]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    made = queries_models.document_features(spark, str(tmp_path))
    text = plan(made)
    assert 0 <= text.index("regexp_replace") < text.index("Join")
    got = {r["entity_id"]: r for r in made.collect()}
    assert sorted(got) == [0, 1, 2] and got[2]["digit_share"] is None
    assert (got[0]["digit_share"], got[0]["upper_share"]) == (2 / 12, 2 / 12)
    assert (got[0]["n_words"], got[0]["n_lines"], got[1]["digit_share"]) == (5.0, 2.0, 0.0)
    assert got[0]["quality"] == 1 and got[0]["toxic"] == 0
