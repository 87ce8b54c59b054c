"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import (
    bpe,
    divergence,
    elias_fano,
    exact_dedup,
    language,
    mixture,
    orchard,
    packing,
    revisits,
    secrets,
    simhash,
    sketch,
    toxicity,
)
from staylens.llm.rows import read, ship
from staylens.session import scratch, tune


BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.toxic_scores(docs, labels).drop("raw")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(read(spark, sf_dir, "documents"))


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    docs = read(spark, sf_dir, "documents")
    elias_fano.write(docs, path, public_tokenizers.path(BYTE_BPE), end_id=2)
    return elias_fano.digests(spark, path)


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.packed_table(docs, public_tokenizers.path(WORD_BPE), end_id=1).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a crawl log derived from ``pages``; headers written in order."""
    log = revisits.captures(read(spark, sf_dir, "pages"))
    entries = F.array_sort(F.map_entries("headers"))
    pairs = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))
    written = F.array_join(pairs, ";")
    return (
        revisits.resolve(log).withColumn("headers", written).withColumnRenamed("at", "revisit_at")
    )


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id % 5 = 2 AS timed FROM pages
), log AS (
  SELECT 2 * page_id AS record_id, true AS full_, url, 10 * page_id AS moment,
         CASE WHEN NOT timed THEN md5(html) END AS etag,
         CASE WHEN timed THEN page_id::VARCHAR END AS modified,
         length(html) AS size, (10 * page_id)::VARCHAR AS day FROM p
  UNION ALL
  SELECT 2 * page_id + 1, false, url || CASE WHEN page_id % 2 = 0 THEN '#seen' ELSE '' END,
         10 * page_id + CASE WHEN page_id % 7 = 0 THEN -4 ELSE page_id % 1000 END,
         CASE WHEN page_id % 11 = 0 THEN 'changed' WHEN NOT timed THEN md5(html) END,
         CASE WHEN timed THEN page_id::VARCHAR END, 0, (10 * page_id + 5)::VARCHAR FROM p
), cut AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare
  FROM log
), parts AS (
  SELECT *, split_part(bare, '?', 1) AS address,
         list_sort([x FOR x IN string_split(regexp_extract(bare, '\?(.*)$', 1), '&')
           IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)')]) AS kept
  FROM cut
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(address, '^[^/]*')), '^(www\.|m\.)', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(address, '/.*$'), '(/index\.html?)?/*$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key
  FROM parts
), found AS (
  SELECT r.record_id, r.key, r.moment, r.etag, r.modified, r.day,
         arg_max(f, (f.moment, f.record_id)) AS f
  FROM keyed r LEFT JOIN keyed f ON f.full_ AND f.key = r.key AND f.moment < r.moment
  WHERE NOT r.full_
  GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN f.record_id IS NULL THEN 'unresolved' WHEN etag = f.etag THEN 'etag'
    WHEN etag IS NULL AND f.etag IS NULL AND modified = f.modified THEN 'last_modified'
    ELSE 'mismatch' END AS status
  FROM found
)
SELECT record_id, key AS canonical_url, moment AS revisit_at, f.record_id AS response_id, f.moment AS response_at, status,
       CASE WHEN status IN ('etag', 'last_modified')
            THEN 'content-length=' || f.size || ';content-type=text/html;date=' || day || ';expires=never' END AS headers
FROM judged
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept,
       s AS text_sha256
FROM t
"""


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), occurring AS (
  SELECT DISTINCT lang, source FROM d
), g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n
  FROM occurring LEFT JOIN cells USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cells c USING (lang, source, term)
), l AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(t.all_n) + 2 * any_value(v.v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM g GROUP BY lang) t USING (lang)
  GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10
"""


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(read(spark, sf_dir, "embeddings")).drop("centroid")


def _op13_sql() -> str:
    """The rounds, written out one after another."""
    steps = [r"""
kept AS (
  SELECT row_number() OVER () AS row, vec_id,
         [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS center
  FROM kept QUALIFY c < 16
)"""]
    for r in range(4):
        steps.append(f"""
d{r} AS (
  SELECT row, vec_id, v, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, center)])::BIGINT AS d
  FROM kept, c{r}
), a{r} AS (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM d{r} GROUP BY row
)""")
        if r < 3:
            steps.append(f"""
s{r} AS (
  SELECT c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM a{r}, range(1, 65) t(i) GROUP BY c, i
), m{r} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS center FROM s{r} GROUP BY c
), c{r + 1} AS (
  SELECT c, coalesce(m{r}.center, c{r}.center) AS center FROM c{r} LEFT JOIN m{r} USING (c)
)""")
    return "WITH" + ",".join(steps) + r"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance,
       sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(center, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""


OPERATORS = (
    (op1_language_id, None),
    (op2_scaled_sketch, None),
    (op3_toxicity, None),
    (op4_elias_fano, None),
    (op5_binary_packing, None),
    (op6_revisits, OP6_SQL),
    (op7_exact_dedup, OP7_SQL),
    (op8_simhash_dedup, None),
    (op9_bpe_round_trip, None),
    (op10_secret_scan, None),
    (op11_source_mix, None),
    (op12_source_divergence, OP12_SQL),
    (op13_orchard_clusters, _op13_sql()),
)


def _tuned(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(tune(spark), sf_dir)

    run.__doc__ = build.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {build.__name__: _tuned(build) for build, _ in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {build.__name__: sql for build, sql in OPERATORS if sql}
