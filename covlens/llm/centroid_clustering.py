"""Clusters of integer vectors around centroids, the nearest one found by the threshold algorithm.

Each component has a list of the centroids sorted by their value there. For a
vector, all lists are walked outward from the vector's own values at once: a
step takes from every list the next nearest centroid, computes the exact
distance of each centroid met for the first time, and adds up the squares of
the gaps at the frontier. No centroid that is still unmet can be nearer than
that sum, so the walk ends when it strictly exceeds the best exact distance;
while they are equal, an unmet centroid of a smaller number could still tie.
The steps are array operations over the vectors of a batch.

A round reads the vectors once, and every task adds up its vectors by centroid;
the driver gets one number per centroid and component. The sums are exact
Python or 64-bit integers, and cross as limbs, so they cannot overflow.

Defined results: a vector is kept if it has exactly ``dims`` components, none
null or not finite (or so large that 1024 times it is not); other rows, and null
vectors, are left out. Start centroids are told by vec_id: a null one comes
last, and of rows with equal ids the one with the smaller components first.
Fewer kept rows than centroids give as many centroids as rows; repeated rows
count one by one; an empty table gives an empty result. A distance or inertia
that no 64-bit integer holds is null. Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
#: What is hashed before a vec_id to draw the start centroids.
SALT = "3:"
#: Vectors handled at once.
BATCH = 4_096
#: Below this, squared distances over 64 components fit 64 bits.
_SMALL = 1 << 27
_LIMB = 48


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers if all are small, else as Python's."""
    scaled = np.floor(SCALE * values)
    if not scaled.size or np.abs(scaled).max() < _SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of x; ties go to the smaller number."""
    (n, dims), k = x.shape, len(centroids)
    big = 1 << 62 if x.dtype != object else 1 << 2300  # beyond any distance
    order = np.argsort(centroids, axis=0, kind="stable")
    value = np.take_along_axis(centroids, order, 0)
    right = np.empty((n, dims), np.int64)
    for j in range(dims):
        right[:, j] = np.searchsorted(value[:, j], x[:, j])
    left, dim = right - 1, np.arange(dims)
    best, cluster = np.full(n, big, x.dtype), np.full(n, k, np.int64)
    met, live = np.zeros((n, k), bool), np.arange(n)
    for _ in range(k):
        at_left, at_right, here = left[live], right[live], x[live]
        gap_left = np.where(at_left >= 0, here - value[np.maximum(at_left, 0), dim], big)
        gap_right = np.where(at_right < k, value[np.minimum(at_right, k - 1), dim] - here, big)
        goes_left = gap_left <= gap_right
        frontier = np.minimum(gap_left, gap_right)
        found = order[np.where(goes_left, at_left, at_right), dim]
        left[live] = at_left - goes_left
        right[live] = at_right + ~goes_left
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], found] = True
        fresh &= ~met[live]
        met[live] |= fresh
        row, c = np.nonzero(fresh)
        exact = np.full((len(live), k), big, x.dtype)
        exact[row, c] = ((here[row] - centroids[c]) ** 2).sum(1)
        first = exact.argmin(1)
        distance = exact[np.arange(len(live)), first]
        better = (distance < best[live]) | ((distance == best[live]) & (first < cluster[live]))
        best[live[better]], cluster[live[better]] = distance[better], first[better]
        live = live[~((frontier**2).sum(1) > best[live])]
        if not len(live):
            break
    return cluster, best


def kept_vectors(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < float("inf"), F.lit(False)))
    return embeddings.select("vec_id", "embedding").filter((F.size("embedding") == dims) & finite)


def start_centroids(vectors: DataFrame, count: int, dims: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "embedding").orderBy(F.asc_nulls_last("h"), "embedding").limit(count).collect()
    return integers(np.array([r["embedding"] for r in rows], np.float64).reshape(-1, dims))


def _limbs(value: int):
    """(place, part) rows that add up to the value as part << (_LIMB * place)."""
    place = 0
    while not -(1 << 62) < value < 1 << 62:
        yield place, value & ((1 << _LIMB) - 1)
        place, value = place + 1, value >> _LIMB
    yield place, value


def _like(centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same kind of integers."""
    return (centroids, x) if centroids.dtype == x.dtype else (centroids.astype(object), x.astype(object))


def _batches(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH):
            yield batch.slice(first, BATCH)


def _sums(centroids: np.ndarray):
    """Rows (cluster, component, limb, part) of a task's sums; the component after the last one is the count."""
    k, dims = centroids.shape

    def run(batches):
        total = [[0] * (dims + 1) for _ in range(k)]
        for batch in _batches(batches):
            c, x = _like(centroids, _matrix(batch.column("embedding"), dims))
            cluster, _ = nearest(x, c)
            for j in range(k):
                mine = x[cluster == j]
                if len(mine):
                    total[j] = [a + int(b) for a, b in zip(total[j], [*mine.sum(0).tolist(), len(mine)], strict=True)]
        rows = [(j, d, *limb) for j in range(k) if total[j][dims] for d in range(dims + 1) for limb in _limbs(total[j][d])]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["cluster", "component", "limb", "part"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; empty centroids stay."""
    parts = vectors.select("embedding").mapInArrow(_sums(centroids), "cluster int, component int, limb int, part long")
    rows = parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    k, dims = centroids.shape
    total = [[0] * (dims + 1) for _ in range(k)]
    for r in rows:
        total[r["cluster"]][r["component"]] += int(r["part"]) << (_LIMB * r["limb"])
    new = [[s // t[dims] for s in t[:dims]] if t[dims] else old for t, old in zip(total, centroids.tolist(), strict=True)]
    small = all(abs(v) < _SMALL for row in new for v in row)
    return np.array(new, np.int64 if small else object).reshape(k, dims)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in _batches(batches):
            c, x = _like(centroids, _matrix(batch.column("embedding"), dims))
            cluster, distance = nearest(x, c)
            held = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _fitting(total: int) -> int | None:
    return total if total < 1 << 63 else None


def cluster(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = kept_vectors(embeddings, dims)
    centroids = start_centroids(vectors, count, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    rows = stored(assigned(vectors, centroids), "assigned")
    held = (F.count("distance") == F.count(F.lit(1))).alias("held")  # else a distance is beyond 64 bits
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), held).collect()  # a row per centroid
    sums = {r["cluster"]: _fitting(int(r["total"])) if r["held"] else None for r in total}
    every = None if None in sums.values() else _fitting(sum(sums.values()))
    named = [(j, s, every, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    named = embeddings.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
