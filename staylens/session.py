"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings.  Timestamps are zone-free, so the zone only has to be
# the same everywhere; skew handling is forced because the aggregates that
# follow our joins can re-shuffle partial results cheaply.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows handed to Python may hold long texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made by someone else."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "staylens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where
    spark-submit and AQE decide; tests and the benchmark pass them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def attach(
    rows: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join large rows with a lookup table that is expected to be small.

    The table is settled first, so the planner knows its true size: below the
    broadcast threshold the rows are not shuffled at all (their keys are often
    few and hot), above it Spark falls back to a shuffled, skew-aware join.
    """
    return rows.join(settle(table), on, how)


def settle(df: DataFrame, options: Mapping[str, str] | None = None) -> DataFrame:
    """Compute ``df`` once: write it to the shared folder and read it back.

    The folder is the one named by ``spark.checkpoint.dir``, so the table
    survives the loss of executors.  A Parquet table, unlike a checkpointed RDD,
    keeps column pruning and gives later joins a known size.  ``options`` are
    those of the Parquet writer.
    """
    path = scratch(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove what is settled inside when the block is left.

    Results are read from settled tables, so write or collect them before.
    """
    written: list[str] = []
    mark = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(mark)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for path in written:
            place = hadoop(path)
            place.getFileSystem(settings).delete(place, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder.

    Without ``spark.checkpoint.dir`` only a local session may make a folder of its own:
    on a cluster each executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="staylens-")
        context.setCheckpointDir(folder)
    path = f"{folder}/staylens/{uuid.uuid4().hex}"
    for written in _scopes.get()[-1:]:
        written.append(path)
    return path
