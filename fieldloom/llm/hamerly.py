"""Exact k-means on integer vectors with Hamerly's bounds.

Each vector keeps one bound above its distance to its own centroid and one below its distance to the second nearest. When
centroids move, the first is loosened by the drift of the own centroid and the second by the largest drift of the others.
While the first stays below the second, or below half the way to the nearest other centroid, the assignment cannot have
changed and nothing is computed; else the own distance is taken anew, and only if that does not decide are all distances.
Distances are whole numbers, ties go to the smaller centroid number, and bounds are rounded away from each other, so the
result is that of a full scan in every round.

A round is one pass that reads the table of the round before and writes the next one, without a shuffle; the sums of a
batch stand in its first row, so that the new centroids need only that column. A lost executor repeats its own part of one
round. The driver holds the k centroids and their sums, whose size does not depend on the number of vectors.

Vectors that are null, of another length, or with null or non-finite components take no part, nor do those with a
component beyond LIMIT(dims), whose squared distances do not fit a long. Repeated rows and ids count each for itself; a null
id is kept, as a seed it comes last. With fewer vectors than k there are fewer centroids; an empty table has no rows.
Extra columns, of whatever name, are not read. Components' sums fit a long up to 2^36 vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.storage import remove, written

#: Share by which a bound is moved outwards after each step of double arithmetic, far more than the step's rounding.
SLACK = 1e-12


def limit(dims: int) -> int:
    """The largest component for which squared distances fit a long."""
    return 1 << (30 - (max(dims - 1, 1).bit_length() + 1) // 2)


@dataclass
class Clusters:
    rows: DataFrame  #: (id, cluster, distance), the distance squared
    centroids: list[list[int]]
    inertia: list[int]  #: of each cluster
    scanned: list[int]  #: vectors whose distances to all centroids were computed, by round


def usable(vector: str, dims: int, scale: int) -> Column:
    """Whether a vector takes part."""
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < limit(dims))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, inside), F.lit(False))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = points - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def above(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * SLACK


def below(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * SLACK


def without_own(values: np.ndarray, best) -> np.ndarray:
    """best (max or min) of all other entries in each row; the rows are entry by entry."""
    return np.array([best(np.delete(row, i)) for i, row in enumerate(values)])


@dataclass
class Step:
    """Centroids of a round with what their movement does to the bounds."""

    centroids: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray) -> Step:
        k = len(new)
        drift = above(np.sqrt(((new - old) ** 2).sum(1)))
        others = without_own(np.tile(drift, (k, 1)), np.max) if k > 1 else np.zeros(1)
        half = below(0.5 * np.sqrt(without_own(squared(new, new), np.min))) if k > 1 else np.full(1, np.inf)
        return cls(new, drift, others, half)

    def assign(self, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each point with new bounds, and how many points were scanned; cluster is -1 before the first round."""
        cluster = cluster.copy()
        upper, lower = above(upper + self.drift[cluster]), below(lower - self.others[cluster])
        safe = np.maximum(lower, self.half[cluster])
        near = np.flatnonzero((cluster >= 0) & ~(upper < safe))
        gap = points[near] - self.centroids[cluster[near]]
        upper[near] = above(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        full = np.flatnonzero((cluster < 0) | ~(upper < safe))
        found = squared(points[full], self.centroids)
        cluster[full] = found.argmin(1)
        ordered = np.sort(found, 1)
        upper[full] = above(np.sqrt(ordered[:, 0]))
        lower[full] = below(np.sqrt(ordered[:, 1])) if found.shape[1] > 1 else np.inf
        return cluster, upper, lower, len(full)


def bytes_of(points: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(points, "<i4").tobytes(), 4 * points.shape[1]
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def sums(k: int, cluster: np.ndarray, points: np.ndarray, scanned: int) -> np.ndarray:
    """[scanned, number of points of each cluster, their sums component by component]."""
    totals = [points[cluster == j].sum(0) for j in range(k)]
    return np.concatenate([[scanned], np.bincount(cluster, minlength=k), *totals])


def first_row(part: np.ndarray, n: int) -> pa.Array:
    return pa.array([part.tolist(), *[None] * (n - 1)], pa.list_(pa.int64()))


def from_input(df: DataFrame, kind: str, dims: int, scale: int, step: Step) -> DataFrame:
    """The first round, over (id, vector) of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.floor(scale * batch.column(1).flatten().to_numpy().reshape(-1, dims)).astype(np.int64)
                yield next_rows(batch.column(0), points, np.full(len(points), -1), np.zeros(len(points)), np.zeros(len(points)), step)

    return df.mapInArrow(run, f"id {kind}, v binary, cluster int, upper double, lower double, part array<long>")


def next_rows(ids: pa.Array, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step) -> pa.RecordBatch:
    cluster, upper, lower, scanned = step.assign(points, cluster, upper, lower)
    part = first_row(sums(len(step.centroids), cluster, points, scanned), len(points))
    columns = [ids, bytes_of(points), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), part]
    return pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "upper", "lower", "part"])


def held(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points, clusters and bounds of a batch of a written round."""
    points = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
    return points, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), batch.column("lower").to_numpy()


def from_round(rows: DataFrame, dims: int, step: Step) -> DataFrame:
    """A later round, over the table of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield next_rows(batch.column("id"), *held(batch, dims), step)

    return rows.select("id", "v", "cluster", "upper", "lower").mapInArrow(run, rows.schema)


def measured(rows: DataFrame, kind: str, dims: int, step: Step) -> DataFrame:
    """The last assignment with squared distances; part is [scanned, inertia of each cluster]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, *state = held(batch, dims)
                cluster, _, _, scanned = step.assign(points, *state)
                gap = points - step.centroids[cluster]
                distance = np.einsum("ij,ij->i", gap, gap)
                part = np.array([scanned, *[distance[cluster == j].sum() for j in range(len(step.centroids))]])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance), first_row(part, len(points))], names=["id", "cluster", "distance", "part"])

    return rows.select("id", "v", "cluster", "upper", "lower").mapInArrow(run, f"id {kind}, cluster int, distance long, part array<long>")


def added(rows: DataFrame) -> list[int]:
    """The parts of all batches, added up place by place; as many numbers as one part has."""
    parts = rows.where("part is not null").select(F.posexplode("part").alias("at", "x"))
    return [r["x"] for r in sorted(parts.groupBy("at").agg(F.sum("x").alias("x")).collect())]


def seeds(vectors: DataFrame, k: int, salt: int, scale: int) -> np.ndarray:
    """The k vectors whose `salt:id` has the least hashes, in that order; equal ones by the vectors themselves."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("vector", key.alias("key")).orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return np.array([np.floor(scale * np.array(r["vector"])) for r in rows]).astype(np.int64)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, salt: int = 3, dims: int = 64, id_column: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Assign and move `rounds` times, then assign once more; components become floor(scale * x).

    A centroid moves to the floor of its vectors' mean, component by component, and stays where it is without any.
    """
    spark, kind = df.sparkSession, df.schema[id_column].dataType.simpleString()
    vectors = df.where(usable(vector, dims, scale)).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    centroids = seeds(vectors, k, salt, scale)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], f"id {kind}, cluster int, distance long"), [], [], [])
    k, step, rows, path, scanned = len(centroids), Step.between(centroids, centroids), None, None, []
    for _ in range(rounds):
        before = path
        rows, path = written(from_input(vectors, kind, dims, scale, step) if rows is None else from_round(rows, dims, step), "vectors")
        if before:
            remove(spark, before)
        total = added(rows)
        scanned.append(total[0])
        counts, totals = total[1 : k + 1], np.array(total[k + 1 :], object).reshape(k, dims)
        moved = np.array([totals[j] // counts[j] if counts[j] else centroids[j] for j in range(k)]).astype(np.int64)
        step, centroids = Step.between(centroids, moved), moved
    if rows is None:
        rows, path = written(from_input(vectors, kind, dims, scale, step), "vectors")
    last, _ = written(measured(rows, kind, dims, step), "clusters")
    remove(spark, path)
    total = added(last)
    return Clusters(last.select("id", "cluster", "distance"), centroids.tolist(), total[1:], [*scanned, total[0]])


def digests(found: Clusters, id_column: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): with the sums of distances and the centroids' hashes."""
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), "cluster")
    return found.rows.select(F.col("id").alias(id_column), "cluster", "distance", of(found.inertia, "long").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))
