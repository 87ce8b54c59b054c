"""How the roles of the operators are bound to the test tables.

Entity = customer or user; stay = order, discharged at the first ship date on or
after the order date; events = the events table; scores come from document
lengths.  The SQL fragments state the same bindings for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import times
from staylens.operators import cohort, features, window
from staylens.session import settle

PROLONGED_DAYS = 400
LAB_HOURS = 8760
ITEM_PATTERNS = {
    "rx_any_fixing": ["ring", "bolt"],
    "rx_any_gear": ["gear"],
    "rx_any_gadget": ["widget", "gizmo"],
}
PROC_PATTERNS = {
    "proc_small_any": ["small", "promo"],
    "proc_standard_any": ["standard"],
    "proc_none_any": ["none"],
}
SEGMENT_RULES = {
    "BUILD": ["building"],
    "AUTO": ["auto"],
    "MACHINE": ["machine", "machinery"],
    "HOME": ["house", "furniture"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ends(*columns: tuple[str, int]) -> list[Column]:
    return [F.round(F.col(c), d).alias(c) for c, d in columns]


def stamps(*columns: str) -> list[Column]:
    """Timestamps as text, so that results compare alike on every engine."""
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in columns]


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# --- stays -----------------------------------------------------------------
def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a shipped line; the rest are dropped.  Settled: plans read it often."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(
        F.col("l_shipdate") >= F.col("o_orderdate")
    )
    first = shipped.groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").agg(
        F.min("l_shipdate").alias("disch")
    )
    died = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 7 == 0)
    return settle(
        first.select(
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderkey").alias("stay_id"),
            F.col("o_orderdate").alias("admit"),
            "disch",
            F.when(died, F.col("disch")).alias("deathtime"),
        )
    )


def first_stays(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Index stays of ``base``, or of all stays; settled."""
    base = stays(spark, sf_dir) if base is None else base
    return settle(cohort.with_los(cohort.index_stay(base)))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index stays of at least the horizon."""
    return cohort.min_stay(first_stays(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    """Customers with a derived gender, birth date and death date."""
    key = F.col("c_custkey")
    base = F.lit("1900-01-01").cast("timestamp_ntz")
    disch = first.select("entity_id", F.col("disch").alias("first_disch"))
    code = F.when(key % 3 == 0, "m").when(key % 3 == 1, "F")
    dod = times.plus_days(F.col("first_disch"), key % 60)
    return (
        table(spark, sf_dir, "customer")
        .withColumn("entity_id", key)
        .join(disch, "entity_id", "left")
        .select(
            "entity_id",
            code.alias("gender"),
            times.plus_days(base, key * 37 % 40000).alias("dob"),
            F.when(F.col("c_acctbal") < 0, dod).alias("dod"),
            F.col("c_mktsegment").alias("ethnicity"),
        )
    )


STAYS_SQL = """
stays AS (
  SELECT o.o_custkey AS entity_id, o.o_orderkey AS stay_id, o.o_orderdate AS admit,
         MIN(l.l_shipdate) AS disch,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_custkey % 7 = 0
              THEN MIN(l.l_shipdate) END AS deathtime
  FROM orders o JOIN lineitem l
    ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate
  GROUP BY o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_orderstatus),
first_stays AS (
  SELECT entity_id, stay_id, admit, disch, deathtime,
         date_diff('microsecond', admit, disch) / 3600000000.0::DOUBLE AS los_hours
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY admit, stay_id) AS rn
        FROM stays) WHERE rn = 1),
idx AS (SELECT * FROM first_stays WHERE los_hours >= 54)"""

ENTITIES_SQL = """
entities AS (
  SELECT c.c_custkey AS entity_id,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'm' WHEN c.c_custkey % 3 = 1 THEN 'F' END AS gender,
         TIMESTAMP '1900-01-01' + to_days((c.c_custkey * 37 % 40000)::INT) AS dob,
         CASE WHEN c.c_acctbal < 0 THEN f.disch + to_days((c.c_custkey % 60)::INT) END AS dod,
         c.c_mktsegment AS ethnicity
  FROM customer c LEFT JOIN first_stays f ON f.entity_id = c.c_custkey)"""

NEXT_SQL = """
nxt AS (
  SELECT i.entity_id, MIN(s.admit) AS next_admit
  FROM idx i JOIN stays s ON s.entity_id = i.entity_id AND s.admit > i.disch
  GROUP BY i.entity_id),
offsets AS (
  SELECT i.entity_id,
         date_diff('microsecond', i.admit, i.disch) / 3600000000.0::DOUBLE AS hours_to_discharge,
         date_diff('microsecond', i.admit, i.deathtime) / 3600000000.0::DOUBLE AS hours_to_stay_death,
         date_diff('microsecond', i.admit, e.dod) / 3600000000.0::DOUBLE AS hours_to_death_date,
         date_diff('microsecond', i.admit, n.next_admit) / 3600000000.0::DOUBLE AS hours_to_next_stay
  FROM idx i LEFT JOIN entities e USING (entity_id) LEFT JOIN nxt n USING (entity_id))"""

LABELS_SQL = """
lab_all AS (
  SELECT i.entity_id, i.stay_id,
         (i.deathtime IS NOT NULL OR COALESCE(e.dod >= i.disch
             AND e.dod <= i.disch + INTERVAL 30 DAY, FALSE))::INT AS mortality_label,
         (i.los_hours > 400 * 24)::INT AS prolonged_los_label,
         COALESCE(n.next_admit <= i.disch + INTERVAL 30 DAY, FALSE)::INT AS readmission_label
  FROM idx i LEFT JOIN entities e USING (entity_id) LEFT JOIN nxt n USING (entity_id)),
label_table AS (
  SELECT * FROM lab_all WHERE entity_id NOT IN (
    SELECT entity_id FROM offsets
    WHERE COALESCE(hours_to_discharge <= 54, FALSE) OR COALESCE(hours_to_stay_death <= 54, FALSE)
       OR COALESCE(hours_to_death_date <= 54, FALSE) OR COALESCE(hours_to_next_stay <= 54, FALSE)))"""

COHORT_SQL = f"WITH {STAYS_SQL}, {ENTITIES_SQL}, {NEXT_SQL}, {LABELS_SQL}"


# --- event slices ----------------------------------------------------------
def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"),
        F.col("user_id").alias("stay_id"),
        F.col("event_type").alias("label"),
        "value",
        F.col("ts").alias("t"),
        "event_id",
        "props",
    )


def user_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of a user as the admission of its only stay."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("stay_id")).agg(F.min("ts").alias("admit"))


def vitals(spark: SparkSession, sf_dir: str, mode: str = "clock_hour") -> DataFrame:
    """Events of the first 48 hours of every user."""
    return window.early_window(
        user_events(spark, sf_dir), user_anchor(spark, sf_dir), mode=mode
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_shipdate").alias("t"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("event_id"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("label"),
        F.col("p_name").alias("drug"),
        "p_size",
    )


def stay_lines(spark: SparkSession, sf_dir: str, stay: DataFrame | None = None) -> DataFrame:
    """Lines of the index stay within the first year."""
    stay = index(spark, sf_dir) if stay is None else stay
    lines = order_lines(spark, sf_dir)
    return window.early_window(lines, stay, hours=LAB_HOURS, carry=["entity_id"])


def labs(spark: SparkSession, sf_dir: str, stay: DataFrame | None = None) -> DataFrame:
    """Lines of the index stay with the part type as label."""
    return window.join_items(stay_lines(spark, sf_dir, stay), items(spark, sf_dir), "item_id")


def feature_blocks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Long blocks: two measured modalities, order flags and calendar parts."""
    stay = settle(index(spark, sf_dir))
    lines = labs(spark, sf_dir, stay)
    rx = features.count_and_flags(lines, column="drug", patterns=ITEM_PATTERNS)
    return {
        "vitals": features.stats_to_long(features.event_stats(vitals(spark, sf_dir)), "vitals"),
        "labs": features.stats_to_long(features.event_stats(lines), "labs"),
        "rx": features.block_to_long(rx, "rx"),
        "calendar": features.block_to_long(features.calendar(stay), "calendar"),
    }


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.to_long(list(feature_blocks(spark, sf_dir).values()))


def settled_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_long as a written table, for plans that read it several times."""
    return settle(feature_long(spark, sf_dir))


VITALS_SQL = """
anchors AS (SELECT user_id, MIN(ts) AS anchor FROM events GROUP BY user_id),
vitals AS (
  SELECT e.user_id AS entity_id, lower(trim(e.event_type)) AS label, e.value, e.ts AS t,
         e.event_id AS tie, a.anchor
  FROM events e JOIN anchors a USING (user_id)
  WHERE date_diff('hour', a.anchor, e.ts) BETWEEN 0 AND 48)"""

LABS_SQL = """
labs AS (
  SELECT i.entity_id, lower(trim(p.p_type)) AS label, l.l_extendedprice AS value,
         l.l_shipdate AS t, l.l_partkey * 1000000 + l.l_suppkey AS tie, p.p_name AS drug
  FROM lineitem l JOIN idx i ON i.stay_id = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
  WHERE date_diff('hour', i.admit, l.l_shipdate) BETWEEN 0 AND 8760)"""


def stats_sql(source: str) -> str:
    return f"""
  SELECT '{source}' AS modality, entity_id, label, avg(value) AS mean,
         stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
         max(value) - min(value) AS range,
         last(value ORDER BY t, tie) AS last, count(*)::DOUBLE AS count, 1.0::DOUBLE AS measured
  FROM {source} GROUP BY entity_id, label"""


RX_SQL = """
rx AS (
  SELECT entity_id, count(*) AS rx_total_mentions, count(DISTINCT lower(drug)) AS rx_unique_drugs,
         max(regexp_matches(lower(drug), 'ring|bolt')::INT) AS rx_any_fixing,
         max(regexp_matches(lower(drug), 'gear')::INT) AS rx_any_gear,
         max(regexp_matches(lower(drug), 'widget|gizmo')::INT) AS rx_any_gadget
  FROM labs GROUP BY entity_id)"""

LONG_SQL = f"""
stats AS ({stats_sql("vitals")} UNION ALL {stats_sql("labs")}),
tall AS (
  UNPIVOT stats ON mean, std, min, max, range, last, count, measured
  INTO NAME stat VALUE value),
cal AS (
  SELECT entity_id, hour(admit)::DOUBLE AS admit_hour, (isodow(admit) >= 6)::INT::DOUBLE AS admit_weekend,
         month(admit)::DOUBLE AS admit_month FROM idx),
rxd AS (
  SELECT entity_id, rx_total_mentions::DOUBLE AS rx_total_mentions,
         rx_unique_drugs::DOUBLE AS rx_unique_drugs, rx_any_fixing::DOUBLE AS rx_any_fixing,
         rx_any_gear::DOUBLE AS rx_any_gear, rx_any_gadget::DOUBLE AS rx_any_gadget FROM rx),
long AS (
  SELECT entity_id, modality, label, stat, modality || ':' || label || '__' || stat AS feature, value
  FROM tall
  UNION ALL
  SELECT entity_id, 'calendar', NULL, NULL, feature, value
  FROM (UNPIVOT cal ON admit_hour, admit_weekend, admit_month INTO NAME feature VALUE value)
  UNION ALL
  SELECT entity_id, 'rx', NULL, NULL, feature, value
  FROM (UNPIVOT rxd ON rx_total_mentions, rx_unique_drugs, rx_any_fixing, rx_any_gear, rx_any_gadget
        INTO NAME feature VALUE value)),
n_all AS (SELECT count(DISTINCT entity_id) AS n FROM long)"""

FEATURES_SQL = f"WITH {STAYS_SQL}, {VITALS_SQL}, {LABS_SQL}, {RX_SQL}, {LONG_SQL}"

PROFILE_SQL = """
present AS (SELECT modality, count(DISTINCT entity_id) AS m FROM long WHERE stat = 'measured' GROUP BY modality),
filled AS (
  SELECT feature, modality, stat, entity_id, value FROM long
  UNION ALL
  SELECT l.feature, l.modality, 'measured', e.entity_id, 0.0
  FROM (SELECT DISTINCT feature, modality FROM long WHERE stat = 'measured') l
  JOIN (SELECT DISTINCT modality, entity_id FROM long WHERE stat = 'measured') e USING (modality)
  WHERE NOT EXISTS (SELECT 1 FROM long x WHERE x.feature = l.feature AND x.entity_id = e.entity_id)),
profile AS (
  SELECT feature, any_value(modality) AS modality, any_value(stat) AS stat, count(value) AS support,
         var_pop(value) * count(value) / (SELECT n FROM n_all) AS variance,
         min(value) AS min_value, max(value) AS max_value, min(value) < max(value) AS is_variable
  FROM filled GROUP BY feature)"""


# --- scored rows -----------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, target, y, p, p2, lang, source, n_chars): two targets per document."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("entity_id"),
        "lang",
        "source",
        "n_chars",
        (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"),
        ((F.col("n_chars") % 1000) / 1000.0).alias("p2"),
        "quality",
        "toxic",
    )
    keep = ["entity_id", "lang", "source", "n_chars", "p", "p2"]
    return rows.unpivot(keep, ["quality", "toxic"], "target", "y")


SCORED_SQL = """
scored AS (
  SELECT l.doc_id AS entity_id, d.lang, d.source, d.n_chars,
         d.n_chars / (d.n_chars + 1500.0::DOUBLE) AS p,
         (d.n_chars % 1000) / 1000.0::DOUBLE AS p2, t.target,
         CASE WHEN t.target = 'quality' THEN l.quality ELSE l.toxic END AS y
  FROM labels l JOIN documents d USING (doc_id)
  CROSS JOIN (VALUES ('quality'), ('toxic')) t(target))"""


def hash_sql(key: str, seed: int | str) -> str:
    """The portable hash in SQL."""
    return f"('0x' || substr(md5({key}::VARCHAR || ':' || '{seed}'), 1, 8))::BIGINT"


