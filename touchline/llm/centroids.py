"""Centroid clustering with bounds loosened by the norm of a total displacement.

Every vector keeps, for each centroid, the last distance that was computed and the round
it was computed in. The centroids of all rounds are retained, so in a later round the
distance to a centroid is at least the stored one minus the length of the straight way
from where that centroid stood then to where it stands now, and at most the stored one
plus it. One straight way is never longer than the sum of the steps between. A centroid
whose lower bound stays above the upper bound of the vector's own centroid can't win and
isn't looked at; any other is computed again, exactly and in whole numbers.

The state of a round is a written table of vectors, labels and bounds; the centroids of
all rounds, ``k`` times the number of rounds and components, are the only data that go
through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.tables import staged
from touchline.llm.vectors import finite, lists, matrix, whole

#: Bounds are compared with this much room for the rounding of square roots.
ROOM = 1e-9
ROWS_AT_ONCE = 2048


@dataclass
class Centroids:
    """The centroids of all rounds, each as whole numbers."""

    history: list[np.ndarray] = field(default_factory=list)

    @property
    def now(self) -> np.ndarray:
        return self.history[-1]

    def moved(self) -> np.ndarray:
        """[round, centroid]: length of the way from its place in that round to its place now."""
        return np.sqrt([((self.now - past) ** 2).sum(1) for past in self.history])

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.now]


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, whole vector) of the rows whose vector has ``size`` finite components."""
    vector = df[vector_col]
    usable = (F.size(vector) == size) & finite(vector)
    return df.filter(usable).select(df[id_col].alias("id"), whole(vector, scale).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest digest of salt and id. Rows that
    share an id are taken in the order of their components, rows without one come last."""
    keyed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "v")
    chosen = keyed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in chosen], np.int64) if chosen else np.zeros((0, 0), np.int64)


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(centers)), np.int64)
    for j, center in enumerate(centers):
        out[:, j] = ((points - center) ** 2).sum(1)
    return out


def assign(
    points: np.ndarray, cluster: np.ndarray, known: np.ndarray, seen: np.ndarray, centroids: Centroids
) -> int:
    """Brings cluster, last known squared distances and their rounds up to the newest
    centroids, in place; the own distance is exact afterwards. Returns the number of
    distances computed."""
    now, rows = len(centroids.history) - 1, np.arange(len(points))
    moved = centroids.moved()
    drift = moved[seen, np.arange(known.shape[1])]
    low = np.sqrt(known) - drift
    own = cluster.copy()
    upper = np.sqrt(known[rows, own]) + drift[rows, own]
    low[rows, own] = np.inf
    open_rows = np.flatnonzero(low.min(1) <= upper * (1 + ROOM) + ROOM)
    centers = centroids.now
    known[rows, own] = ((points - centers[own]) ** 2).sum(1)
    seen[rows, own] = now
    exact = np.sqrt(known[rows, own])
    at, j = np.nonzero(low[open_rows] <= (exact[open_rows] * (1 + ROOM) + ROOM)[:, None])
    at = open_rows[at]
    known[at, j] = ((points[at] - centers[j]) ** 2).sum(1)
    seen[at, j] = now
    # a centroid that wasn't looked at is strictly farther than the own one
    rivals = np.where(seen[open_rows] == now, known[open_rows], np.iinfo(np.int64).max)
    cluster[open_rows] = rivals.argmin(1)
    return len(points) + len(at)


STATE = T.StructType(
    [
        T.StructField("v", T.ArrayType(T.IntegerType())),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("known", T.ArrayType(T.LongType())),
        T.StructField("seen", T.ArrayType(T.ByteType())),
        T.StructField("computed", T.LongType()),
    ]
)


def _assigning(centroids: Centroids, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, v) in the first round, of (id, state) later, to the new state."""
    k = len(centroids.now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, ROWS_AT_ONCE):
                batch = whole_batch.slice(first, ROWS_AT_ONCE)
                points = matrix(batch.column("v"), size)
                if "cluster" in batch.schema.names:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    known, seen = matrix(batch.column("known"), k), matrix(batch.column("seen"), k)
                    computed = assign(points, cluster, known, seen, centroids)
                else:
                    known = _distances(points, centroids.now)
                    seen, cluster = np.zeros_like(known), known.argmin(1)
                    computed = known.size
                per_row = np.zeros(len(points), np.int64)
                per_row[0] = computed
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("v"),
                        pa.array(cluster, pa.int32()),
                        lists(known, pa.int64()),
                        lists(seen, pa.int8()),
                        pa.array(per_row, pa.int64()),
                    ],
                    names=["id", *STATE.names],
                )

    return run


def _sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows per cluster, component sums per cluster). Each batch is summed in its task, so
    a cluster with most of the rows costs one row per batch in the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, cluster = matrix(batch.column("v"), size), batch.column("cluster").to_numpy()
            present = np.unique(cluster)
            sums = np.array([points[cluster == c].sum(0) for c in present], np.int64).reshape(len(present), size)
            counts = np.array([(cluster == c).sum() for c in present], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(present, pa.int32()), pa.array(counts, pa.int64()), lists(sums, pa.int64())],
                names=["cluster", "n", "sums"],
            )

    parts = state.select("v", "cluster").mapInArrow(partial, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums")
    )
    counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for row in totals.collect():  # at most k rows
        counts[row.cluster], sums[row.cluster] = row.n, row.sums
    return counts, sums


def clustered(
    df: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
    salt: str = "1:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """Each kept vector's ``id``, whole vector ``v``, ``cluster`` and exact squared
    ``distance``, with the ``computed`` distances of the last round, and the centroids.

    Vectors that are null, have another number of components than ``size``, or a null or
    non-finite component are left out. A component becomes ``floor(scale * x)``. The
    centroids start as ``seeds``; each round assigns every vector to the nearest one (the
    smaller number on ties) and moves every centroid that has vectors to their
    componentwise mean, rounded down. A last assignment follows the rounds. With fewer
    than ``k`` kept vectors there are as many centroids; without any, no rows. Repeated rows
    and rows without an id take part each; other columns aren't read, whatever their names.
    Components beyond 2^27 whole units raise an error.
    """
    vectors = kept_vectors(df, id_col, vector_col, size, scale)
    start = seeds(vectors, k, salt)
    centroids = Centroids([start])
    id_field = T.StructField("id", df.schema[id_col].dataType)
    schema = T.StructType([id_field, *STATE.fields])
    if not len(start):
        return vectors.sparkSession.createDataFrame([], schema).withColumn("distance", F.lit(0).cast("long")), centroids
    state = vectors
    for number in range(rounds + 1):
        state = staged(state.mapInArrow(_assigning(centroids, size), schema), f"centroids-{number}")
        if number < rounds:
            counts, sums = _sums(state, len(start), size)
            moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids.now)
            centroids = Centroids([*centroids.history, moved])
    return state.withColumn("distance", F.col("known")[F.col("cluster")]), centroids


def with_totals(found: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (sums of the distances over the cluster and over
    all vectors) and ``centroid_sha256``. One row per centroid is joined."""
    spark = found.sparkSession
    per_cluster = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, t, sum(per_cluster.values()), centroids.digests()[c]) for c, t in per_cluster.items()]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return found.join(F.broadcast(spark.createDataFrame(rows, names)), "cluster")
