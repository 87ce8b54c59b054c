"""Queries: windows, index stays, slices, labels and cohort attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import text, times
from staylens.functions.numbers import to_number
from staylens.operators import cohort, features, labels, window
from staylens.operators.prune import require_columns
from staylens.plans import bindings as b
from staylens.plans.registry import query
from staylens.sources.tables import lower_columns, with_defaults


def _stats(mode: str):
    def build(spark, d):
        stats = features.event_stats(b.vitals(spark, d, mode))
        return stats.select(
            "entity_id", "label", *b.ends(("mean", 6), ("std", 6), ("min", 6), ("max", 6),
                                          ("range", 6), ("last", 6)), F.col("count").alias("n"),
        )

    return build


_STATS_SQL = """
SELECT entity_id, label, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(max(value) - min(value), 6) AS range,
       round(last(value ORDER BY t, tie), 6) AS last, count(*) AS n
FROM vitals GROUP BY entity_id, label"""

query("event_stats_48h", f"WITH {b.VITALS_SQL} {_STATS_SQL}")(_stats("clock_hour"))
query(
    "event_window_elapsed",
    "WITH "
    + b.VITALS_SQL.replace(
        "date_diff('hour', a.anchor, e.ts) BETWEEN 0 AND 48",
        "e.ts >= a.anchor AND e.ts < a.anchor + INTERVAL 48 HOUR",
    )
    + _STATS_SQL,
)(_stats("elapsed"))


@query(
    "window_compliance",
    f"""WITH {b.STAYS_SQL}, {b.VITALS_SQL},
o AS (
  SELECT 'events' AS modality, anchor AS a, t, 48 AS h FROM vitals
  UNION ALL
  SELECT 'lines', i.admit, l.l_shipdate, 48 FROM lineitem l JOIN idx i ON i.stay_id = l.l_orderkey
  WHERE date_diff('hour', i.admit, l.l_shipdate) BETWEEN 0 AND 8760),
x AS (SELECT modality, date_diff('microsecond', a, t) / 3600000000.0::DOUBLE AS off,
             date_diff('hour', a, t) AS hb, h FROM o)
SELECT modality, count(*) AS n_events, round(min(off), 3) AS min_offset_hours,
       round(max(off), 3) AS max_offset_hours, max(hb) AS max_boundaries,
       count(*) FILTER (WHERE off < 0 OR off >= h) AS n_outside,
       round(avg((off < 0 OR off >= h)::INT), 6) AS violation_rate
FROM x GROUP BY modality""",
)
def window_compliance(spark, d):
    events = b.vitals(spark, d).select(F.lit("events").alias("modality"), "admit", "t")
    lines = window.early_window(b.order_lines(spark, d), b.index(spark, d), hours=b.LAB_HOURS)
    lines = lines.select(F.lit("lines").alias("modality"), "admit", "t")
    out = window.window_compliance(events.unionByName(lines))
    return out.select(
        "modality", "n_events", *b.ends(("min_offset_hours", 3), ("max_offset_hours", 3)),
        "max_boundaries", "n_outside", *b.ends(("violation_rate", 6)),
    )


@query(
    "index_stay",
    f"""SELECT o_custkey AS entity_id, o_orderkey AS stay_id, {b.stamp_sql("o_orderdate")} AS admit,
       o_orderstatus AS status, o_totalprice AS price
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
      FROM orders) WHERE rn = 1""",
)
def index_stay(spark, d):
    return _shown(cohort.index_stay(_orders(spark, d)))


def _shown(rows):
    return rows.select("entity_id", "stay_id", *b.stamps("admit"), "status", "price")


def _orders(spark, d, price=None):
    return b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("admit"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") if price is None else price).alias("price"),
    )


@query(
    "index_stay_nonnull",
    f"""WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price FROM orders)
SELECT o_custkey AS entity_id, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS stay_id,
       {b.stamp_sql("min(o_orderdate)")} AS admit, first(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS status,
       first(price ORDER BY o_orderdate, o_orderkey) FILTER (WHERE price IS NOT NULL) AS price
FROM o GROUP BY o_custkey""",
)
def index_stay_nonnull(spark, d):
    price = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return _shown(cohort.index_stay(_orders(spark, d, price), mode="first_non_null"))


def _slice(how):
    def build(spark, d):
        small = b.items(spark, d).filter(F.col("p_size") <= 25).select("item_id", "label")
        joined = window.join_items(b.stay_lines(spark, d), small, "item_id", how)
        return joined.groupBy(text.normal_label(F.col("label")).alias("label")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("entity_id").alias("n_entities"),
            F.round(F.sum("value"), 2).alias("total"),
            F.max(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("last_time"),
        )

    return build


_SLICE_SQL = """WITH {stays}
SELECT lower(trim(coalesce(p.p_type, 'none'))) AS label, count(*) AS n,
       count(DISTINCT i.entity_id) AS n_entities, round(sum(l.l_extendedprice), 2) AS total,
       strftime(max(l.l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_time
FROM lineitem l JOIN idx i ON i.stay_id = l.l_orderkey
{how} JOIN (SELECT * FROM part WHERE p_size <= 25) p ON p.p_partkey = l.l_partkey
WHERE date_diff('hour', i.admit, l.l_shipdate) BETWEEN 0 AND 8760
GROUP BY 1"""
query("item_slice_inner", _SLICE_SQL.format(stays=b.STAYS_SQL, how="INNER"))(_slice("inner"))
query("item_slice_left", _SLICE_SQL.format(stays=b.STAYS_SQL, how="LEFT"))(_slice("left"))


@query(
    "rx_counts_flags",
    f"""WITH x AS (
  SELECT o.o_custkey AS entity_id, p.p_name AS drug FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey),
{b.RX_SQL.replace("FROM labs", "FROM x")}
SELECT * FROM rx""",
)
def rx_counts_flags(spark, d):
    return features.count_and_flags(_drug_lines(spark, d), patterns=b.ITEM_PATTERNS)


def _drug_lines(spark, d):
    lines = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = b.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    named = joined.withColumnRenamed("l_partkey", "item_id")
    return window.join_items(named, b.items(spark, d), "item_id", "left")


@query(
    "proc_flags",
    """WITH x AS (
  SELECT o.o_custkey AS entity_id, lower(coalesce(p.p_type, 'none')) AS w FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON p.p_partkey = l.l_partkey)
SELECT entity_id, max(regexp_matches(w, 'small|promo')::INT) AS proc_small_any,
       max(regexp_matches(w, 'standard')::INT) AS proc_standard_any,
       max(regexp_matches(w, 'none')::INT) AS proc_none_any
FROM x GROUP BY entity_id""",
)
def proc_flags(spark, d):
    lines = b.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    orders = b.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    small = b.items(spark, d).filter(F.col("p_size") <= 25)
    named = window.join_items(joined, small, "item_id", "left").withColumnRenamed(
        "label", "item_label"
    )
    return features.procedure_flags(named, patterns=b.PROC_PATTERNS)


@query(
    "stay_los_filter",
    f"""WITH {b.STAYS_SQL}
SELECT entity_id, stay_id, {b.stamp_sql("admit")} AS admit, {b.stamp_sql("disch")} AS disch,
       {b.stamp_sql("deathtime")} AS deathtime, round(los_hours, 6) AS los_hours FROM idx""",
)
def stay_los_filter(spark, d):
    times_shown = b.stamps("admit", "disch", "deathtime")
    return b.index(spark, d).select("entity_id", "stay_id", *times_shown, *b.ends(("los_hours", 6)))


@query("labels_mortality", f"{b.COHORT_SQL} SELECT entity_id, stay_id, mortality_label FROM lab_all")
def labels_mortality(spark, d):
    first = b.first_stays(spark, d)
    return labels.label_death(cohort.min_stay(first), b.entities(spark, d, first))


@query(
    "labels_prolonged", f"{b.COHORT_SQL} SELECT entity_id, stay_id, prolonged_los_label FROM lab_all"
)
def labels_prolonged(spark, d):
    return labels.label_prolonged(b.index(spark, d), b.PROLONGED_DAYS)


@query(
    "labels_readmission", f"{b.COHORT_SQL} SELECT entity_id, stay_id, readmission_label FROM lab_all"
)
def labels_readmission(spark, d):
    base = b.stays(spark, d)
    return labels.label_readmission(cohort.min_stay(b.first_stays(spark, d, base)), base)


@query(
    "early_exclusion",
    f"""{b.COHORT_SQL}
SELECT o.entity_id, round(hours_to_discharge, 6) AS hours_to_discharge,
       round(hours_to_stay_death, 6) AS hours_to_stay_death,
       round(hours_to_death_date, 6) AS hours_to_death_date,
       round(hours_to_next_stay, 6) AS hours_to_next_stay,
       (t.entity_id IS NOT NULL)::INT AS kept
FROM offsets o LEFT JOIN label_table t USING (entity_id)""",
)
def early_exclusion(spark, d):
    first = b.first_stays(spark, d)
    index = cohort.min_stay(first)
    offsets = cohort.early_event_offsets(index, b.stays(spark, d), b.entities(spark, d, first))
    kept = cohort.exclude_early(index, offsets).select("entity_id", F.lit(1).alias("k"))
    return offsets.join(kept, "entity_id", "left").select(
        "entity_id",
        *[F.round(c, 6).alias(c) for c in cohort.OFFSETS],
        F.coalesce("k", F.lit(0)).alias("kept"),
    )


def _label_table(spark, d, base=None, first=None):
    base = b.stays(spark, d) if base is None else base
    first = b.first_stays(spark, d, base) if first is None else first
    return labels.label_table(
        cohort.min_stay(first), base, b.entities(spark, d, first), prolonged_days=b.PROLONGED_DAYS
    )


@query("label_table", f"{b.COHORT_SQL} SELECT * FROM label_table")
def label_table(spark, d):
    return _label_table(spark, d)


@query(
    "label_prevalence",
    f"""{b.COHORT_SQL},
tall AS (UNPIVOT label_table ON mortality_label, prolonged_los_label, readmission_label
         INTO NAME target VALUE y)
SELECT target, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(y), 6) AS prevalence,
       min(y) AS min_y, max(y) AS max_y, (min(y) >= 0 AND max(y) <= 1)::INT AS is_binary,
       round((1 - avg(y)) / greatest(avg(y), 1e-6), 6) AS pos_weight
FROM tall GROUP BY target""",
)
def label_prevalence(spark, d):
    out = labels.prevalence(_label_table(spark, d))
    return out.withColumn("prevalence", F.round("prevalence", 6)).withColumn(
        "pos_weight", F.round("pos_weight", 6)
    )


@query(
    "cohort_attrition",
    f"""{b.COHORT_SQL},
s AS (
  SELECT 0 AS ordinal, 'stays' AS step, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM stays
  UNION ALL SELECT 1, 'index_stays', count(*), count(DISTINCT entity_id) FROM first_stays
  UNION ALL SELECT 2, 'minimum_stay', count(*), count(DISTINCT entity_id) FROM idx
  UNION ALL SELECT 3, 'labelled', count(*), count(DISTINCT entity_id) FROM label_table)
SELECT * FROM s""",
)
def cohort_attrition(spark, d):
    base = b.stays(spark, d)
    first = b.first_stays(spark, d, base)
    return cohort.attrition(
        {
            "stays": base,
            "index_stays": first,
            "minimum_stay": cohort.min_stay(first),
            "labelled": _label_table(spark, d, base, first),
        }
    )


@query(
    "demographics_block",
    f"""WITH {b.STAYS_SQL}, {b.ENTITIES_SQL},
x AS (
  SELECT i.entity_id, e.gender, lower(coalesce(e.ethnicity, 'none')) AS s,
         date_diff('microsecond', e.dob, i.admit) AS gap FROM idx i LEFT JOIN entities e USING (entity_id)),
y AS (
  SELECT *, CASE WHEN gap IS NULL THEN 65.0 WHEN gap < 0 OR gap > 54787.5 * 86400000000 THEN 65.0
            ELSE least(greatest(floor(gap / 86400000000.0::DOUBLE) / 365.25::DOUBLE, 0), 120) END AS a,
  CASE WHEN s LIKE '%building%' THEN 'BUILD' WHEN s LIKE '%auto%' THEN 'AUTO'
       WHEN s LIKE '%machine%' OR s LIKE '%machinery%' THEN 'MACHINE'
       WHEN s LIKE '%house%' OR s LIKE '%furniture%' THEN 'HOME' ELSE 'OTHER' END AS bk FROM x)
SELECT entity_id, round((CASE WHEN a >= 89 THEN 90.0 ELSE a END)::DOUBLE, 6) AS age,
       coalesce(upper(gender) = 'M', FALSE)::INT AS "gender_M",
       coalesce(upper(gender) = 'F', FALSE)::INT AS "gender_F",
       (bk = 'BUILD')::INT AS "eth_BUILD", (bk = 'AUTO')::INT AS "eth_AUTO",
       (bk = 'MACHINE')::INT AS "eth_MACHINE", (bk = 'HOME')::INT AS "eth_HOME",
       (bk = 'OTHER')::INT AS "eth_OTHER"
FROM y""",
)
def demographics_block(spark, d):
    first = b.first_stays(spark, d)
    people = b.entities(spark, d, first)
    index = cohort.min_stay(first).join(people.select("entity_id", "ethnicity"), "entity_id", "left")
    block = features.demographics(index, people.drop("ethnicity"), b.SEGMENT_RULES)
    return block.withColumn("age", F.round("age", 6))


@query(
    "admission_time_block",
    """SELECT o_orderkey AS entity_id, hour(o_orderdate)::INT AS admit_hour,
       (isodow(o_orderdate) >= 6)::INT AS admit_weekend, month(o_orderdate)::INT AS admit_month
FROM orders""",
)
def admission_time_block(spark, d):
    orders = b.table(spark, d, "orders")
    return features.calendar(
        orders.select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderdate").alias("admit"))
    )


@query(
    "label_topk",
    """WITH c AS (
  SELECT CASE WHEN p_size % 10 = 0 THEN p_size::VARCHAR ELSE lower(trim(p_name)) END AS label,
         count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
t AS (SELECT * FROM c ORDER BY n DESC, label LIMIT 20)
SELECT label, n FROM t WHERE NOT regexp_full_match(label, '[0-9]+')""",
)
def label_topk(spark, d):
    name = F.when(F.col("p_size") % 10 == 0, F.col("p_size").cast("string")).otherwise(F.col("drug"))
    labelled = b.items(spark, d).select("item_id", text.normal_label(name).alias("label"))
    counts = (
        b.table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(labelled, "item_id")
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )
    return features.top_labels(counts, 20).filter(~text.digits_only(F.col("label")))


@query(
    "coerce_values",
    r"""WITH x AS (
  SELECT event_id, '  ' || upper(event_type) || ' ' AS raw_label,
    CASE event_id % 8 WHEN 0 THEN ' 1.5 ' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN 'nan'
      WHEN 4 THEN '1_000' WHEN 5 THEN '1.5d' WHEN 6 THEN regexp_extract(props, '[0-9]+')
      ELSE value::VARCHAR END AS v,
    CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS tt
  FROM events),
y AS (
  SELECT event_id, lower(trim(raw_label)) AS label,
    CASE WHEN regexp_full_match(v, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
         THEN trim(v)::DOUBLE END AS value,
    TRY_CAST(tt AS TIMESTAMP) AS t FROM x)
SELECT label, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS max_value,
       strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time
FROM y WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY label""",
)
def coerce_values(spark, d):
    kind = F.col("event_id") % 8
    raw = (
        F.when(kind == 0, " 1.5 ").when(kind == 1, "abc").when(kind == 2, "").when(kind == 3, "nan")
        .when(kind == 4, "1_000").when(kind == 5, "1.5d")
        .when(kind == 6, F.regexp_extract("props", "[0-9]+", 0))
        .otherwise(F.col("value").cast("string"))
    )
    stamp = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    dirty = b.table(spark, d, "events").select(
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("label"),
        raw.alias("value"),
        stamp.alias("t"),
    )
    return features.clean_events(dirty).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.max("value"), 4).alias("max_value"),
        F.max(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("last_time"),
    )


@query(
    "cohort_filter",
    f"""WITH {b.STAYS_SQL}
SELECT c.c_custkey AS entity_id, c.c_name AS full_name, s.stay_id AS first_stay_id,
       {b.stamp_sql("s.admit")} AS admit
FROM customer c JOIN first_stays s ON s.entity_id = c.c_custkey
WHERE c.c_acctbal IS NOT NULL AND c.c_custkey IN (SELECT entity_id FROM idx)""",
)
def cohort_filter(spark, d):
    people = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("full_name"), "c_acctbal"
    )
    kept = cohort.within_cohort(people.filter(F.col("c_acctbal").isNotNull()), b.index(spark, d))
    stay = b.first_stays(spark, d).select(
        "entity_id", F.col("stay_id").alias("first_stay_id"), *b.stamps("admit")
    )
    return kept.drop("c_acctbal").join(stay, "entity_id").orderBy("entity_id", "admit")


@query(
    "normalise_columns",
    """SELECT c_custkey AS subject_id, c_name, c_acctbal, 'UNKNOWN' AS ethnicity, 65 AS age FROM customer""",
)
def normalise_columns(spark, d):
    people = b.table(spark, d, "customer").drop("c_mktsegment", "c_nationkey")
    upper = people.toDF(*[c.upper() for c in people.columns]).withColumnRenamed(
        "C_CUSTKEY", "SubjectID"
    )
    plain = with_defaults(lower_columns(upper), {"ethnicity": "UNKNOWN", "age": 65})
    return require_columns(plain, ["subject_id"]).select(
        "subject_id", "c_name", "c_acctbal", "ethnicity", "age"
    )


@query(
    "entity_attributes",
    """WITH f AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
                 FROM orders) WHERE rn = 1)
SELECT c_custkey AS entity_id, c_mktsegment AS segment, f.o_orderkey AS stay_id, f.o_totalprice AS price
FROM customer LEFT JOIN f ON f.o_custkey = c_custkey""",
)
def entity_attributes(spark, d):
    firsts = cohort.one_per_entity(_orders(spark, d), "entity_id", ["admit", "stay_id"])
    people = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment")
    )
    return people.join(firsts.select("entity_id", "stay_id", "price"), "entity_id", "left")


@query(
    "hour_boundaries",
    """SELECT event_id, date_diff('hour', anchor, ts) AS boundaries,
       round(date_diff('microsecond', anchor, ts) / 3600000000.0::DOUBLE, 2) AS hours
FROM events JOIN (SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id) USING (user_id)""",
)
def hour_boundaries(spark, d):
    joined = b.user_events(spark, d).join(b.user_anchor(spark, d), "stay_id")
    return joined.select(
        "event_id",
        times.hour_boundaries(F.col("admit"), F.col("t")).alias("boundaries"),
        F.round(times.hours_between(F.col("admit"), F.col("t")), 2).alias("hours"),
    )


@query(
    "numeric_text",
    r"""SELECT conv_id, turn,
  CASE WHEN regexp_full_match(text, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
       THEN trim(text)::DOUBLE END AS number, length(lower(trim(coalesce(text, 'none')))) AS label_length
FROM conversations""",
)
def numeric_text(spark, d):
    rows = b.table(spark, d, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        to_number(F.col("text")).alias("number"),
        F.length(text.normal_label(F.col("text"))).cast("long").alias("label_length"),
    )
