"""Queries: splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import cohort, features, sampling
from staylens.plans import bindings as b
from staylens.plans.registry import query
from staylens.session import scratch
from staylens.sources import files

SEED = 42
N_BOOT = 2000
CAP = 150


def _labels(spark, d):
    return b.table(spark, d, "labels")


def _ranked(seed, by=None):
    part = f"PARTITION BY {by} " if by else ""
    size = f"PARTITION BY {by}" if by else ""
    return f"""WITH h AS (SELECT *, {b.hash_sql("doc_id", seed)} AS hash FROM labels),
r AS (SELECT *, row_number() OVER ({part}ORDER BY hash, doc_id) - 1 AS rk,
             count(*) OVER ({size}) AS n FROM h)"""


_SPLIT = f"""{_ranked(SEED, "quality")},
s AS (SELECT doc_id, quality, toxic, CASE WHEN rk < floor(n * 0.6::DOUBLE + 0.5) THEN 'train'
             WHEN rk < floor(n * 0.8::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _split(spark, d):
    return sampling.stratified_split(_labels(spark, d), "doc_id", "quality", seed=SEED)


@query("split_stratified", f"{_SPLIT} SELECT doc_id, quality, split FROM s")
def split_stratified(spark, d):
    return _split(spark, d).select("doc_id", "quality", "split")


@query(
    "kfold_stratified",
    f"""{_ranked(SEED, "quality")}
SELECT doc_id, quality, (rk >= floor((n * 1 + 4) / 5))::INT + (rk >= floor((n * 2 + 4) / 5))::INT
  + (rk >= floor((n * 3 + 4) / 5))::INT + (rk >= floor((n * 4 + 4) / 5))::INT AS fold FROM r""",
)
def kfold_stratified(spark, d):
    return sampling.stratified_folds(_labels(spark, d), "doc_id", "quality", 5, SEED).select(
        "doc_id", "quality", "fold"
    )


@query(
    "downsample_majority",
    f"""{_ranked(SEED, "quality")}, p AS (SELECT count(*) AS all_n, count(*) FILTER (WHERE quality = 1) AS pos FROM labels)
SELECT doc_id, quality, toxic FROM r, p
WHERE quality = 1 OR rk < greatest({CAP} - pos, 0)""",
)
def downsample_majority(spark, d):
    return sampling.downsample_majority(_labels(spark, d), "doc_id", "quality", CAP, SEED)


@query(
    "background_sample",
    f"""{_ranked(SEED, "quality")}, c AS (SELECT count(*) AS all_n, count(*) FILTER (WHERE quality = 1) AS pos FROM labels),
p AS (SELECT least(pos, greatest(least(pos, {CAP // 2}), {CAP} - (all_n - pos))) AS keep FROM c)
SELECT doc_id, quality, toxic FROM r, p
WHERE rk < CASE WHEN quality = 1 THEN keep ELSE {CAP} - keep END""",
)
def background_sample(spark, d):
    return sampling.background_sample(_labels(spark, d), "doc_id", "quality", CAP, SEED)


@query("sample_n", f"{_ranked(7)} SELECT doc_id, quality, toxic FROM r WHERE rk < 100")
def sample_n(spark, d):
    return sampling.sample_n(_labels(spark, d), "doc_id", 100, 7)


@query(
    "split_by_counts",
    f"""{_ranked(2025)}
SELECT doc_id, CASE WHEN rk < 60 THEN 'train' WHEN rk < 80 THEN 'val' ELSE 'test' END AS split
FROM r WHERE rk < 100""",
)
def split_by_counts(spark, d):
    return sampling.split_by_counts(_labels(spark, d), "doc_id", (60, 20, 20)).select(
        "doc_id", "split"
    )


@query(
    "union_splits",
    f"""{_SPLIT} SELECT doc_id, quality, toxic FROM s WHERE split IN ('train', 'val')""",
)
def union_splits(spark, d):
    split = _split(spark, d)
    train = split.filter(F.col("split") == "train").drop("split")
    return train.unionByName(split.filter(F.col("split") == "val").drop("split"))


@query(
    "split_restrict",
    f"""{_SPLIT} SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM s WHERE split = 'test')""",
)
def split_restrict(spark, d):
    test = _split(spark, d).filter(F.col("split") == "test")
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return cohort.within_cohort(docs, test, "doc_id")


@query(
    "align_labels",
    """SELECT l.doc_id AS entity_id, l.quality, d.n_chars, d.lang, NULL::DOUBLE AS absent
FROM labels l JOIN documents d USING (doc_id)""",
)
def align_labels(spark, d):
    labels = _labels(spark, d).select(F.col("doc_id").alias("entity_id"), "quality")
    docs = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("entity_id"), "n_chars", "lang"
    )
    joined = features.join_labels(docs, labels)
    return features.final_columns(joined, ["quality", "n_chars", "lang", "absent"])


@query(
    "bootstrap_poisson",
    f"""WITH x AS (SELECT k.i AS blk, sha256(l.doc_id::VARCHAR || ':' || k.i::VARCHAR || ':42') AS dg
           FROM labels l, range(0, {N_BOOT // sampling.REPLICATES}) k(i)),
w AS (SELECT (blk * {sampling.REPLICATES} + j.i)::INT AS replicate, {sampling.weight_sql("substr(dg, 8 * j.i + 1, 8)")} AS weight
      FROM x, range(0, {sampling.REPLICATES}) j(i))
SELECT replicate, count(*) FILTER (WHERE weight > 0) AS n_rows, sum(weight)::BIGINT AS drawn FROM w GROUP BY replicate""",
)
def bootstrap_poisson(spark, d):
    sums = sampling.replicate_sums(
        _labels(spark, d), "doc_id", N_BOOT, [],
        {"n_rows": lambda w: (w > 0).cast("long"), "drawn": lambda w: w}, SEED,
    )
    return sampling.replicate_rows(sums, N_BOOT, [], ["n_rows", "drawn"])


@query(
    "split_chunks",
    f"""{_SPLIT} SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM s WHERE split = 'test')""",
)
def split_chunks(spark, d):
    """Documents of the test split, by a chunked manifest that was written and read back."""
    path = scratch(spark)
    split = _split(spark, d).withColumnRenamed("doc_id", "entity_id")
    files.write_chunked_split(split, path, SEED, chunk=100)
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), "lang", "n_chars")
    return files.read_chunked_split(spark, path, "test", docs).withColumnRenamed("entity_id", "doc_id")


@query(
    "table1",
    f"""{_SPLIT},
j AS (SELECT s.split, s.quality, s.toxic, d.n_chars, d.lang FROM s JOIN documents d USING (doc_id)),
c AS (
  SELECT 'n_chars' AS characteristic, split,
         printf('%.2f (%.2f)', round(avg(n_chars), 2), round(stddev_samp(n_chars), 2)) AS cell FROM j GROUP BY split
  UNION ALL SELECT 'quality', split, printf('%.1f%%', round(100 * avg(quality), 1)) FROM j GROUP BY split
  UNION ALL SELECT 'toxic', split, printf('%.1f%%', round(100 * avg(toxic), 1)) FROM j GROUP BY split
  UNION ALL SELECT 'lang=' || lang, split,
    printf('%.1f%%', round(100.0::DOUBLE * count(*) / any_value(t.n), 1)) FROM j JOIN (SELECT split, count(*) AS n FROM j GROUP BY split) t USING (split)
    GROUP BY lang, split)
SELECT characteristic, max(cell) FILTER (WHERE split = 'train') AS train,
       max(cell) FILTER (WHERE split = 'val') AS val, max(cell) FILTER (WHERE split = 'test') AS test
FROM c GROUP BY characteristic""",
)
def table1(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    rows = _split(spark, d).join(docs, "doc_id")
    return features.baseline_table(rows, ["n_chars"], ["quality", "toxic"], ["lang"])
