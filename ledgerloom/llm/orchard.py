"""Centroid clustering: k-means whose nearest-centroid step is Orchard's search.

Every centroid has a list of the others, nearest first. A vector starts at the centroid closest to the centroids' mean and walks that
centroid's list; as soon as a closer centroid is found the walk jumps to the list of that one. Centroids met once are marked and not
measured again, and a walk ends where the listed centroid lies strictly beyond twice the current distance: by the triangle
inequality neither it nor any later one can be nearer, nor as near. All vectors of a slice walk side by side in numpy.

The k x width centroids are what travels to the tasks. A round sends k partial sums per task to the shuffle and k sums to the
driver, never a vector. Components become floor(scale x) first, so every distance, sum and centroid is an exact integer.

Defined results: vectors that are null, of another width, or that hold null or non-finite components take no part. Ties go to the
smaller centroid; equal vectors share a cluster; rows of the same id are rows of their own. First centroids are the vectors with the
smallest hashes of their ids; a null id hashes last, and equal hashes are ordered by their components. With fewer vectors than k
there are as many centroids as vectors. A centroid without vectors stays where it is. An empty table gives no rows. A
distance that a long cannot hold is an error. Columns of the caller are kept unless they bear the name of a result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import shielded
from ledgerloom.plans.shared import over_all_cores, runs_in_tasks, staged

runs_in_tasks(__name__)

K = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
SEED = 1


def integer_vectors(batch: pa.RecordBatch, vec: str, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vector takes part, and their floor(scale x)."""
    column = batch.column(vec)
    right = pc.equal(pc.fill_null(pc.list_value_length(column), -1), width)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    sound = np.isfinite(values).all(axis=1)
    values = np.floor(values[sound] * scale)
    if len(values) and width * 4 * float(np.abs(values).max()) ** 2 >= 2.0**60:
        raise OverflowError("components are too large for squared distances in 64 bits")
    return rows[sound], values.astype(np.int64)


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.gaps = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(self.gaps, axis=1, kind="stable")
        n = len(points)
        self.lists = order[order != np.arange(n)[:, None]].reshape(n, n - 1)
        self.start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance to it, for every row; and how many distances were computed."""
        n, k = len(x), len(self.points)
        current = np.full(n, self.start)
        best = ((x - self.points[self.start]) ** 2).sum(axis=1)
        met = np.zeros((n, k), bool)
        met[:, self.start] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while True:
            walking = walking[place[walking] < k - 1]
            if not len(walking):
                return current, best, int(met.sum())
            listed = self.lists[current[walking], place[walking]]
            # Squares: strictly beyond twice the distance means beyond four times its square.
            near = self.gaps[current[walking], listed] <= 4 * best[walking]
            walking, listed = walking[near], listed[near]
            place[walking] += 1
            fresh = ~met[walking, listed]
            row, centroid = walking[fresh], listed[fresh]
            met[row, centroid] = True
            distance = ((x[row] - self.points[centroid]) ** 2).sum(axis=1)
            closer = (distance < best[row]) | ((distance == best[row]) & (centroid < current[row]))
            row, centroid = row[closer], centroid[closer]
            current[row], best[row], place[row] = centroid, distance[closer], 0


def first_centroids(vectors: DataFrame, k: int, seed: int, id_: str, vec: str, width: int, scale: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest SHA-256."""

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integer_vectors(batch, vec, width, scale)
            flat = pa.array(x.reshape(-1), pa.int64())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_).take(pa.array(rows)), pa.ListArray.from_arrays(ends, flat)], names=["id", "x"]
            )

    schema = T.StructType([T.StructField("id", vectors.schema[id_].dataType), T.StructField("x", T.ArrayType(T.LongType()))])
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = vectors.select(id_, vec).mapInArrow(integers, schema).orderBy(F.asc_nulls_last(mark), "x").limit(k)
    return [row["x"] for row in chosen.select("x").collect()]


def next_centroids(vectors: DataFrame, centroids: Centroids, vec: str, scale: int) -> np.ndarray:
    """Every centroid moved to the floor of the mean of its vectors."""
    k, width = centroids.points.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, x = integer_vectors(batch, vec, width, scale)
            cluster, _, _ = centroids.nearest(x)
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "x"],
        )

    parts = vectors.select(vec).mapInArrow(sums, "cluster long, n long, x array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.select("cluster", "n", F.posexplode("x").alias("i", "x")).groupBy("cluster", "i").agg(exact("n").alias("n"), exact("x").alias("x"))
    moved = centroids.points.copy()
    for row in rows.collect():  # k x width rows
        moved[row["cluster"], row["i"]] = int(row["x"]) // int(row["n"])
    return moved


def assign(vectors: DataFrame, centroids: Centroids, vec: str, scale: int, keep: list[str]) -> DataFrame:
    """Nearest centroid and squared distance of every vector that takes part, beside its kept columns."""
    width = centroids.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integer_vectors(batch, vec, width, scale)
            cluster, distance, _ = centroids.nearest(x)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in keep), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=[*keep, "cluster", "distance"],
            )

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    columns = list(dict.fromkeys([*keep, vec]))
    return vectors.select(*columns).mapInArrow(run, T.StructType([vectors.schema[c] for c in keep] + fields))


def cluster_vectors(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED,
    id_: str = "vec_id", vec: str = "embedding", keep: list[str] | None = None,
) -> DataFrame:
    """Cluster, squared distance, inertia of the cluster and of all, and the centroid, for every vector that takes part."""
    return shielded(vectors, [id_, vec], lambda d, own: _clustered(d, k, rounds, width, scale, seed, id_, vec, own), keep)


def _clustered(
    vectors: DataFrame, k: int, rounds: int, width: int, scale: int, seed: int, id_: str, vec: str, keep: list[str] | None
) -> DataFrame:
    spark = vectors.sparkSession
    vectors = over_all_cores(vectors)
    kept = [c for c in vectors.columns if keep is None or c in keep]
    first = first_centroids(vectors, k, seed, id_, vec, width, scale)
    result = T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()),
        T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())),
    ])
    if not first:
        return spark.createDataFrame([], T.StructType([vectors.schema[c] for c in kept] + result.fields))
    centroids = Centroids(np.array(first, np.int64))
    for _ in range(rounds):
        centroids = Centroids(next_centroids(vectors, centroids, vec, scale))
    assigned = staged(assign(vectors, centroids, vec, scale, kept), "clusters")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total = sum(row["s"] for row in sums)
    rows = [(row["cluster"], row["s"], total, centroids.points[row["cluster"]].tolist()) for row in sums]
    about = spark.createDataFrame(rows, T.StructType([f for f in result.fields if f.name != "distance"]))
    return assigned.join(F.broadcast(about), "cluster").select(*kept, *result.names)
