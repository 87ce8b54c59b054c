"""Reading and binding the source tables.

Operators use generic column names (entity_id, stay_id, admit, ...).  A binding
says how a source table's columns map to them; the defaults fit a hospital
schema of admissions, patients and four event tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from staylens.operators.prune import QualityError, require_columns
from staylens.session import tune

# Source column -> generic column, per table.
STAYS = {
    "subject_id": "entity_id", "hadm_id": "stay_id", "admittime": "admit",
    "dischtime": "disch", "deathtime": "deathtime",
}
STAY_DETAILS = {
    "admission_type": "admission_type", "admission_location": "admission_location",
    "discharge_location": "discharge_location", "diagnosis": "diagnosis",
    "insurance": "insurance", "language": "language",
    "marital_status": "marital_status", "ethnicity": "ethnicity",
}
ENTITIES = {
    "subject_id": "entity_id", "gender": "gender", "dob": "dob", "dod": "dod",
    "expire_flag": "expire_flag",
}
VITALS = {
    "subject_id": "entity_id", "hadm_id": "stay_id", "icustay_id": "unit_stay_id",
    "charttime": "t", "itemid": "item_id", "valuenum": "value", "valueuom": "unit",
}
LABS = {
    "subject_id": "entity_id", "hadm_id": "stay_id", "charttime": "t", "itemid": "item_id",
    "valuenum": "value", "value": "value_text", "valueuom": "unit", "flag": "flag",
}
PRESCRIPTIONS = {
    "subject_id": "entity_id", "hadm_id": "stay_id", "startdate": "t", "enddate": "t_end",
    "drug": "drug", "drug_type": "drug_type", "formulary_drug_cd": "drug_code", "route": "route",
}
PROCEDURES = {
    "subject_id": "entity_id", "hadm_id": "stay_id", "icustay_id": "unit_stay_id",
    "starttime": "t", "endtime": "t_end", "itemid": "item_id",
    "ordercategoryname": "order_category", "ordercategorydescription": "order_description",
    "location": "location",
}
ITEMS = {"itemid": "item_id", "label": "item_label"}

ENTITY_ALIASES = {"subjectid": "subject_id"}


def lower_columns(df: DataFrame, aliases: Mapping[str, str] = ENTITY_ALIASES) -> DataFrame:
    """Lower-case every column name, then rename known aliases if the name is free."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise QualityError("column names collide when lower-cased")
    for alias, name in aliases.items():
        if alias in names and name not in names:
            names[names.index(alias)] = name
    return df.toDF(*names)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add optional columns that are absent, filled with a default."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def zone_free(df: DataFrame) -> DataFrame:
    """Turn zoned timestamps into zone-free ones (session zone is UTC)."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def read_table(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = (),
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read a table with normalised column names and check the required ones."""
    tune(spark)
    df = zone_free(lower_columns(spark.read.format(fmt).options(**options).load(path)))
    return require_columns(df, required, path)


def bind(
    df: DataFrame, mapping: Mapping[str, str], optional: Sequence[str] = ()
) -> DataFrame:
    """Select and rename the mapped columns; absent optional ones become NULL."""
    df = lower_columns(df)
    columns = []
    for source, name in mapping.items():
        if source in df.columns:
            columns.append(F.col(source).alias(name))
        elif source in optional:
            columns.append(F.lit(None).cast("string").alias(name))
        else:
            raise QualityError(f"column {source!r} is missing")
    return df.select(*columns)


def cohort_ids(
    spark: SparkSession, path: str, column: str = "subject_id", name: str = "entity_id"
) -> DataFrame:
    """Distinct whole-number ids of a CSV file; a missing column is an error."""
    df = lower_columns(spark.read.csv(path, header=True))
    require_columns(df, [column], path)
    ids = F.col(column).try_cast("double").cast("long").alias(name)
    return df.select(ids).filter(F.col(name).isNotNull()).distinct()


def id_frame(spark: SparkSession, ids: Sequence[int], name: str = "entity_id") -> DataFrame:
    """A cohort from ids in the program; an empty list matches nothing."""
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint").distinct()
