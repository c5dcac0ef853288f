"""Centroid clustering of whole-number vectors with a LAESA pivot table.

The distances of every vector to fixed pivots are computed once and stored
beside it. A round compares pivot distances only: for every pivot p, a vector x
is at least |d(x, p) - d(c, p)| away from a centroid c. The centroid of the
smallest bound is measured first; of the others only those whose bound does not
exceed the best distance so far get an exact whole-number distance. Pivots are
the starting centroids, from which later ones drift only a little, and
``far_pivots`` rows that lie far apart among the ``PIVOT_ROWS`` smallest hashes
(greedily, by summed distance, as in LAESA). Pivots decide how much is spared,
never the result.

Every round reads the stored table once; a task sends one row per centroid and
component (sums and counts), and the driver sees the k x dim sums of all. Those
sizes do not depend on the number of vectors. Sums are decimals of 38 digits.

Defined results: a component is floor(scale * x), cut to the range of a long;
vectors of another length, null ones and those with null or non-finite
components take no part; a repeated id is a vector of its own; a null id is
clustered, but starts a centroid only after all others; equal starting hashes
go by components; with fewer than k vectors there are fewer centroids; empty
centroids stay where they are; distances and sums beyond a long become its
largest value; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight.llm.common import Scratch, list_values
from sitelight.llm.topk import usable

#: Rows among which the far pivots are chosen.
PIVOT_ROWS = 1024
LONG_MAX = 2**63 - 1
#: A task's sum of distances stops here: far beyond a long, within a decimal.
ENOUGH = 10**30
#: Below this reach, squares of differences add up exactly in longs.
REACH = 2**26
#: Relative room for rounding in bounds; whole-number distances are exact.
SLACK = 1e-12


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") == dim) & usable("vector"))
    return rows.select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"))


def by_hash(rows: DataFrame, seed: int, n: int) -> list[list[int]]:
    """The vectors of the n rows with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.vector for r in rows.orderBy(digest.asc_nulls_last(), "vector").limit(n).collect()]


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to c (one vector, or one per row): longs,
    or unbounded integers where longs could overflow."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(c.astype(float)).max(initial=0)) < REACH / max(1, x.shape[1]) ** 0.5:
        delta = x - c
        return np.einsum("ij,ij->i", delta, delta)
    delta = x.astype(object) - c.astype(object)
    return (delta * delta).sum(axis=1)


def _far(sample: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The pivots, and n rows of the sample with the largest summed distance to
    those before them."""
    total = np.zeros(len(sample))
    for p in pivots:
        total += np.sqrt(_exact(sample, p).astype(float))
    for _ in range(min(n, len(sample))):
        best = int(total.argmax())
        pivots = np.vstack([pivots, sample[best]])
        total += np.sqrt(_exact(sample, sample[best]).astype(float))
        total[best] = -np.inf
    return pivots


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(_exact(x, p).astype(float)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def assign(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, exact squared distance, distances that were computed)."""
    bound = np.zeros((len(x), len(centroids)))
    of_pivots = pivot_distances(centroids, pivots)
    for j in range(pivots.shape[0]):
        ours, theirs = to_pivots[:, j, None], of_pivots[None, :, j]
        np.maximum(bound, np.abs(ours - theirs) - SLACK * (ours + theirs), out=bound)
    bound = bound * bound * (1 - SLACK)
    cluster = bound.argmin(axis=1)
    best = _exact(x, centroids[cluster])
    measured = len(x)
    first = cluster.copy()
    for c in range(len(centroids)):
        open_rows = np.flatnonzero((bound[:, c] <= best.astype(float) * (1 + SLACK)) & (first != c))
        distance = _exact(x[open_rows], centroids[c])
        measured += len(open_rows)
        ours = best[open_rows]
        better = (distance < ours) | ((distance == ours) & (c < cluster[open_rows]))
        if distance.dtype != best.dtype:
            best = best.astype(object)
        best[open_rows[better]] = distance[better]
        cluster[open_rows[better]] = c
    return cluster, best, measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return list_values(column)[1].to_numpy().reshape(len(column), width)


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_distances(_matrix(batch.column(1), pivots.shape[1]), pivots)
            offsets = np.arange(len(table) + 1, dtype=np.int32) * len(pivots)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "vector", "to_pivots"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1), centroids.shape[1])
            yield batch.column(0), x, *assign(x, _matrix(batch.column(2), len(pivots)), centroids, pivots)


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Per task (cluster, place, total, n): sums by component; at place -1 those of
    the distances, at place -2 the number of distances that were computed."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim + 2), dtype=object), np.zeros(k, dtype=np.int64)
        for _, x, cluster, distance, measured in _assigned(batches, centroids, pivots):
            wide = x if np.abs(x.astype(float)).max(initial=0) * len(x) < 2**62 else x.astype(object)
            reach = distance.astype(float).max(initial=0) * len(x) < 2**62
            for c in np.unique(cluster):
                mine = cluster == c
                count[c] += mine.sum()
                total[c, :dim] += wide[mine].sum(axis=0).astype(object)
                total[c, dim] += int((distance if reach else distance.astype(object))[mine].sum())
            total[0, dim + 1] += measured
        total[:, dim] = np.minimum(total[:, dim], ENOUGH)
        places = np.r_[np.arange(dim), -1, -2]
        rows = [pa.array(np.repeat(np.arange(k), dim + 2), pa.int32()), pa.array(np.tile(places, k), pa.int32())]
        rows.append(pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0)))
        rows.append(pa.array(np.repeat(count, dim + 2)))
        yield pa.RecordBatch.from_arrays(rows, names=["cluster", "place", "total", "n"])

    return run


def _labels(centroids: np.ndarray, pivots: np.ndarray, inertia: list[int], names: list[str]):
    own = np.array([min(v, LONG_MAX) for v in inertia])
    whole = min(sum(inertia), LONG_MAX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance, _ in _assigned(batches, centroids, pivots):
            cut = np.minimum(distance, LONG_MAX).astype(np.int64)
            sha = pa.DictionaryArray.from_arrays(pa.array(cluster, pa.int32()), pa.array(names)).cast(pa.string())
            columns = [ids, pa.array(cluster, pa.int32()), pa.array(cut), pa.array(own[cluster]), pa.array(np.full(len(cluster), whole)), sha]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(
    vectors: DataFrame, k: int, rounds: int, seed: int, dim: int, scale: int, far_pivots: int = 8, id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, list[list[int]], list[float]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every vector that takes part; the final centroids; and, by round, the share of
    all vector-centroid distances that had to be computed."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dim, scale, id_column, vector_column)
    sample = np.array(by_hash(rows, seed, max(k, PIVOT_ROWS)), dtype=np.int64).reshape(-1, dim)
    starts = sample[:k]
    pivots = _far(sample, starts, far_pivots)
    stored = Scratch(spark).write(rows.mapInArrow(_with_pivots(pivots), "vec_id long, vector array<long>, to_pivots array<double>"), "laesa-table")
    layout = "cluster int, place int, total decimal(38,0), n long"

    def summed(centroids: np.ndarray) -> tuple[np.ndarray, list[int], list[int], float]:
        found = stored.mapInArrow(_sums(centroids, pivots), layout).groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        total, count, inertia, measured = np.zeros(centroids.shape, dtype=object), [0] * len(centroids), [0] * len(centroids), 0
        for r in found:
            if r.place >= 0:
                total[r.cluster, r.place] = int(r.total)
            elif r.place == -1:
                count[r.cluster], inertia[r.cluster] = r.n, int(r.total)
            else:
                measured += int(r.total)
        return total, count, inertia, measured / max(1, sum(count) * len(centroids))

    centroids, shares = starts, []
    for _ in range(rounds if len(starts) else 0):
        total, count, _, share = summed(centroids)
        shares.append(share)
        centroids = np.array([[int(v) // n for v in row] if n else list(old) for row, n, old in zip(total, count, centroids, strict=True)], dtype=np.int64)
    _, _, inertia, share = summed(centroids) if len(starts) else (None, [], [], 0.0)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    layout = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return stored.mapInArrow(_labels(centroids, pivots, inertia, names), layout), centroids.tolist(), [*shares, share]
