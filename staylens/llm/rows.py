"""Small helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a Python helper turns into objects at a time; texts may be long.
SLICE = 256
# Largest number of keys treated as hot: a key is hot beyond 1/HOT_PARTS of the rows.
HOT_PARTS = 1024
HOT_FLOOR = 1000


def ship(spark: SparkSession) -> None:
    """Give the Python workers this library, once per application."""
    context = spark.sparkContext
    if getattr(context, "_staylens_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="staylens-"), "staylens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._staylens_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(df: DataFrame) -> int:
    """Partitions to deal a shuffle to, as the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[dict[str, list]]:
    """Arrow batches as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size).to_pydict()


def batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema}, schema=schema)


def shares(counts: DataFrame, n: str = "n") -> tuple[DataFrame, int]:
    """The hot keys of ``counts`` and the rows one share of a hot key may have.

    A key is hot beyond 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS of
    them: the returned table is small enough to broadcast whatever the input.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(HOT_FLOOR, -(-total // HOT_PARTS))
    return counts.where(F.col(n) > share), share


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened until no taken name equals them in any case."""
    used, out = {name.lower() for name in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``members`` (doc_id, raw, stays) marks to go.

    Rows are recognised by id and hash of the text.  Members that repeat both are
    indistinguishable to that test: of those that may stay one is kept.  Rows meet their
    members by a shuffle at every size: which side is small does not depend on the data.
    """
    key, hash_, n = fresh(docs.columns, "member", "hash", "n")
    named = members.select(F.col("doc_id").alias(key), F.col("raw").alias(hash_ + "_of"), "stays")
    named = named.groupBy(key, hash_ + "_of").agg(
        F.count("*").alias(n), F.max("stays").alias("stays")
    )
    gone = named.where(~F.col("stays") | (F.col(n) > 1))
    again = named.where(F.col("stays") & (F.col(n) > 1))
    rows_ = docs.withColumn(hash_, F.xxhash64(text_or_empty()))
    same = rows_["doc_id"].cast("long").eqNullSafe(F.col(key)) & (
        F.col(hash_) == F.col(hash_ + "_of")
    )
    lone = rows_.hint("shuffle_merge").join(gone.select(key, hash_ + "_of"), same, "left_anti")
    if again.isEmpty():
        return lone.drop(hash_)
    one = rows_.join(again.select(key, hash_ + "_of"), same, "left_semi")
    return lone.unionByName(one.dropDuplicates(["doc_id", hash_])).drop(hash_)
