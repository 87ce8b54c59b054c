"""Centroid clustering with Orchard search.

Each centroid keeps the others in order of distance.  A vector starts at one centroid and
reads that centroid's list; whenever a closer centroid is met it jumps to the list of that
one, centroids already met are marked, and the search stops at an entry strictly beyond
twice the distance held: by the triangle inequality nothing from there on is as close.
Tasks search all vectors of an Arrow batch in step.  Only sums per centroid reach the
driver, at most centroids x components numbers a round.

All arithmetic is on integers.  Cases: a NULL vector, one of another length, or one with a
NULL or non-finite component is left out; a component beyond ``largest`` raises, since its
distances might not fit a long; a NULL id takes part and comes last in the choice of the
first centroids; repeated rows each count; equally near centroids give the smaller number;
with fewer vectors than centroids there are as many centroids as vectors; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.session import settle

CENTROIDS = 16  # neighbour lists hold centroids squared entries in every task
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
SEED = 1
AT_ONCE = 4096  # vectors searched in step

ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def largest(components: int) -> int:
    """The largest component whose squared distances surely fit a long."""
    return int((2**62 / components) ** 0.5) // 2


def on_grid(
    vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """The usable vectors as integers: (vec_id, v) with floor(scale * x) per component."""
    x = F.col(column).cast("array<double>")
    usable = (F.size(x) == components) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    )
    top = largest(components)
    fits = F.forall(x, lambda e: F.abs(e * scale) < top)
    whole = F.transform(x, lambda e: F.floor(e * scale).cast("int"))
    beyond = F.raise_error(F.lit(f"a component is beyond {top} on the grid"))
    return vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(fits, whole).otherwise(beyond.cast("array<int>")).alias("v"),
    )


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.gaps = np.stack([squared(self.centroids, c) for c in self.centroids])
        order = self.gaps.copy()
        np.fill_diagonal(order, -1)  # itself first, also among equal centroids
        self.lists = np.argsort(order, axis=1, kind="stable")[:, 1:]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each vector, and distances computed."""
        n, k = len(vectors), len(self.centroids)
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = squared(vectors, self.centroids[0])
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        work = n
        live = np.arange(n if k > 1 else 0)
        while live.size:
            other = self.lists[at[live], place[live]]
            # gap > 2 d, on squares and without overflow
            near = (self.gaps[at[live], other] - 1) // 4 < best[live]
            live, other = live[near], other[near]
            place[live] += 1
            new = ~met[live, other]
            who, other = live[new], other[new]
            met[who, other] = True
            found = squared(vectors[who], self.centroids[other])
            work += who.size
            closer = (found < best[who]) | ((found == best[who]) & (other < at[who]))
            who, other, found = who[closer], other[closer], found[closer]
            at[who], best[who], place[who] = other, found, 0
            live = live[place[live] < k - 1]
        return at, best, work


def matrices(batches, components: int):
    """(vec_ids, vectors) of a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id"), flat.reshape(-1, components).astype(np.int64)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = points.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k)
    return np.array([row["v"] for row in chosen.collect()], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors, empty ones as they are."""
    k, components = centroids.shape

    def run(batches):
        search = Orchard(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for _, vectors in matrices(batches, components):
            at, _, _ = search.nearest(vectors)
            counts += np.bincount(at, minlength=k)
            np.add.at(sums, at, vectors)
        used = np.flatnonzero(counts)
        yield rows.batch(
            SUMS,
            {"cluster": used, "n": counts[used], "sums": sums[used].tolist()},
        )

    parts = points.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = (
        parts.select("cluster", "n", F.posexplode("sums").alias("component", "part"))
        .groupBy("cluster", "component")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    )
    out = centroids.copy()
    for row in totals.collect():  # at most k x components
        out[row["cluster"], row["component"]] = int(row["total"]) // row["n"]
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    components = centroids.shape[1]

    def run(batches):
        search = Orchard(centroids)
        for ids, vectors in matrices(batches, components):
            at, best, _ = search.nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(at.astype(np.int32)), pa.array(best)], schema=ASSIGNED
            )

    return points.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    column: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid per vector."""
    spark = vectors.sparkSession
    schema = (
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, "
        "centroid array<long>"
    )
    points = settle(on_grid(vectors, column, components, scale))
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        none = points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.join(spark.createDataFrame([], schema), "cluster").select(*RESULT)
    for _ in range(rounds):
        centroids = moved(points, centroids)
    found = settle(assigned(points, centroids))
    inertia = dict.fromkeys(range(len(centroids)), 0)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    for row in sums.collect():  # at most k
        inertia[row["cluster"]] = int(row["s"])
    total = sum(inertia.values())
    table = [
        (c, inertia[c], total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
        for c, v in enumerate(centroids.tolist())
    ]
    # At most k rows.
    return found.join(F.broadcast(spark.createDataFrame(table, schema)), "cluster").select(*RESULT)


RESULT = (
    "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
)
