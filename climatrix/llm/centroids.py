"""Centroid clustering: Lloyd rounds in exact integers, nearest centroids by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value in it. For a vector, each list is walked
outward from the vector's own value; a centroid met in any list is compared with the vector exactly.
A centroid not yet met lies at least as far as the frontier in every dimension, so
the walk ends when the frontier distances' sum is strictly greater than the best exact distance: an equal
one could still belong to a smaller number. Vectors of a batch are walked together in numpy.

Vectors are stored once as integers; a round reads them, sums each task's vectors per cluster, and Spark adds
up the tasks' sums. Only centroids (k times the components) reach the driver.

Defined results: vectors with another number of components, or with a null or non-finite one, are left out, so
is a null vector. Components beyond +-32768 count as that, which keeps squared distances within a long. Repeated
rows are vectors of their own; sums of distances beyond a long count as the largest long; equal hashes (repeated ids) are ordered by the vectors, null ids come last as seeds.
Fewer than k vectors give as many centroids; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm.tables import stored
from climatrix.llm.text import releasing

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
#: Largest component before scaling: (2 * 2**25)**2 * 64 stays far below 2**63.
LARGEST = float(1 << 15)
#: Vectors walked at a time.
BLOCK = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of every row of ``x`` (int64); ties go to the smaller number."""
    k, dims = centroids.shape
    lists = np.argsort(centroids, axis=0, kind="stable")  # (place, dimension): centroid numbers in ascending value
    value = np.take_along_axis(centroids, lists, axis=0)
    every = np.arange(dims)
    label = np.full(len(x), k, dtype=np.int64)
    best = np.full(len(x), np.iinfo(np.int64).max, dtype=np.int64)
    at = np.arange(len(x))  # rows still walked
    right = np.zeros((len(x), dims), dtype=np.int64)
    for place in range(k):
        right += value[place] < x
    left = right - 1
    met = np.zeros((len(x), k), dtype=bool)
    for _ in range(k):
        own = x[at]
        down = np.where(left >= 0, own - value[np.maximum(left, 0), every], np.iinfo(np.int64).max)
        up = np.where(right < k, value[np.minimum(right, k - 1), every] - own, np.iinfo(np.int64).max)
        lower = down <= up
        new = np.zeros((len(at), k), dtype=bool)
        new[np.arange(len(at))[:, None], lists[np.where(lower, left, right), every]] = True
        for j in range(k):
            rows = np.flatnonzero(new[:, j] & ~met[:, j])
            far = ((own[rows] - centroids[j]) ** 2).sum(axis=1)
            better = (far < best[at[rows]]) | ((far == best[at[rows]]) & (j < label[at[rows]]))
            best[at[rows[better]]], label[at[rows[better]]] = far[better], j
        met |= new
        frontier = (np.minimum(down, up) ** 2).sum(axis=1)
        go = frontier <= best[at]
        if not go.any():
            break
        left, right = (left - lower)[go], (right + ~lower)[go]
        met, at = met[go], at[go]
    return label, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def integer_vectors(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v, the components floor(1024 * x), of the vectors that are kept."""
    fine = F.expr(f"size(embedding) = {dims} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    inside = F.transform("embedding", lambda x: F.floor(SCALE * F.least(F.greatest(x.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))).cast("int"))
    return embeddings.where(fine).select("vec_id", inside.alias("v"))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, total (decimal), n: sums of the vectors nearest to each centroid, one partial sum a task."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("v"), dims)
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                label, _ = nearest(part, centroids)
                for j in range(k):
                    total[j] += part[label == j].sum(axis=0)
                n += np.bincount(label, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(releasing(run), "cluster long, n long, total array<long>")
    rows = parts.where("n > 0").select("cluster", "n", F.posexplode("total").alias("dim", "part"))
    return rows.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def centroids_of(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 3) -> np.ndarray:
    """The centroids after ``rounds`` rounds (int64, k rows at most), starting from the vectors with the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in start], dtype=np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in _sums(vectors, centroids).collect():  # k * dims rows
            moved[r.cluster, r.dim] = int(r.total) // r.n
        if (moved == centroids).all():
            break  # the rounds left would change nothing
        centroids = moved
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), centroids.shape[1])
            for i in range(0, len(x), BLOCK):
                label, far = nearest(x[i : i + BLOCK], centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(i, len(label)), pa.array(label.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(releasing(run), f"vec_id {kind}, cluster int, distance long")


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its components) of every kept vector."""
    vectors = stored(integer_vectors(embeddings, dims), "centroid-vectors")
    centroids = centroids_of(vectors, k, rounds, dims, seed)
    rows = stored(assigned(vectors, centroids), "centroid-members")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    spark = embeddings.sparkSession
    top = (1 << 63) - 1
    known = [(j, min(sums.get(j, 0), top), min(sum(sums.values()), top), c.tolist()) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    """Hash of a centroid's components joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
