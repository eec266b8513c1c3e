"""Centroid clustering in integers, with screening in float32.

Vectors become integers; assignments, sums and centroids are exact, so the
result doesn't depend on how rows are dealt out. Most of the work is a float32
matrix product of vectors and centroids. Its rounding error has a rigorous
bound, so each squared distance lies in a known interval: a centroid whose
interval begins above the least end of all is out. Where more than one is left,
their distances are computed again in integers, and the smaller number wins a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved

#: Largest absolute value of an integer component: squared distances of 64 of them fit 63 bits.
LARGEST = 1 << 27
#: Numbers in a block of vectors by centroids.
BLOCK = 1 << 20
#: Unit roundoff of float32.
UNIT = 2.0**-24


def packed_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, packed): vectors of ``dims`` components, none null or non-finite, as int32 floor(scale * x)."""
    wanted = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
            values = batch.column("vector").flatten()
            x = np.asarray(pc.fill_null(values, float("nan"))).reshape(-1, dims)
            good = np.isfinite(x).all(1)
            whole = np.floor(x[good] * scale)
            if whole.size and np.abs(whole).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST // scale} has squared distances that a long can't hold")
            data = whole.astype("<i4").tobytes()
            ends = np.arange(good.sum() + 1, dtype=np.int32) * (4 * dims)
            made = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), made], names=["vec_id", "packed"])

    return wanted.mapInArrow(pack, "vec_id long, packed binary")


def _unpacked(column, dims: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), np.int64)
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(data, "<i4", len(column) * dims, first).reshape(-1, dims).astype(np.int64)


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid or to as many."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Nearest:
    """Finds each vector's nearest centroid; ``undecided`` counts vectors that float32 left open."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.exact = centroids
        self.rounded = centroids.astype(np.float32)
        n = centroids.shape[1]
        self.norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        self.square = (centroids.astype(np.float64) ** 2).sum(1)
        # Rounding of both factors to float32 and of a sum of n products in any order, with or without fused steps.
        k = (n + 2) * UNIT
        self.gamma = k / (1 - k) * (1 + 1e-9)
        self.undecided = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        out = np.zeros(len(x), np.int64)
        step = max(1, BLOCK // max(1, len(self.exact)))
        for i in range(0, len(x), step):
            out[i : i + step] = self._block(x[i : i + step])
        return out, exact_distances(x, self.exact[out]) if len(x) else np.zeros(0, np.int64)

    def _block(self, x: np.ndarray) -> np.ndarray:
        about = (x.astype(np.float32) @ self.rounded.T).astype(np.float64)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        # What the squares have in common is left out; float64 adds a relative error of a few times 2**-53.
        middle = self.square - 2 * about
        error = 2 * self.gamma * size[:, None] * self.norm + 2.0**-48 * (self.square + 2 * np.abs(about)) + 2.0**-20
        low, high = middle - error, (middle + error).min(1)
        left = low <= high[:, None]
        best = left.argmax(1)
        open_ = np.flatnonzero(left.sum(1) > 1)
        self.undecided += len(open_)
        if len(open_):
            r, c = np.nonzero(left[open_])
            far = exact_distances(x[open_[r]], self.exact[c])
            order = np.lexsort((c, far, r))
            first = np.append(True, r[order][1:] != r[order][:-1])
            best[open_] = c[order[first]]
        return best


def _summed(centroids: np.ndarray):
    """Of a task's vectors by cluster: the count (dim -1) and the sum of each component."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums, counts = Nearest(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _unpacked(batch.column("packed"), dims)
            if not len(x):
                continue
            which, _ = near(x)
            order = np.argsort(which, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(which[order]) != 0))
            sums[which[order][cut]] += np.add.reduceat(x[order], cut, axis=0)
            counts += np.bincount(which, minlength=k)
        some = np.flatnonzero(counts)
        total = np.column_stack([counts[some], sums[some]]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(some)), pa.int32()), pa.array(total, pa.int64())], names=["cluster", "dim", "total"])

    return run


def _assigned(centroids: np.ndarray, more: dict[str, list] | None = None):
    """(vec_id, cluster, distance) of each vector, and what ``more`` says of its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(centroids)
        for batch in batches:
            which, far = near(_unpacked(batch.column("packed"), centroids.shape[1]))
            columns = {"vec_id": batch.column("vec_id"), "cluster": pa.array(which, pa.int32()), "distance": pa.array(far, pa.int64())}
            columns |= {c: pa.array(v).take(pa.array(which)) for c, v in (more or {}).items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, or with one that is null or not
    finite, are left out, as are null vectors. The first centroids are the k vectors
    whose ids have the smallest hashes; rows that share an id, or have none (it counts
    as the text "null"), go by their components after that, and all rows count in
    sums. Fewer than k vectors give fewer centroids; an empty table gives an empty
    one; other columns are ignored. A component beyond LARGEST / scale is an error.

    The driver holds k centroids and, after each round, k sums: k * (dims + 1)
    numbers, whatever the number of vectors. Rounds are scans without a shuffle of vectors.
    """
    kept = saved(packed_vectors(vectors, key, vector, dims, scale), "vectors")
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))
    first = kept.select(F.sha2(F.concat(F.lit(seed), name).cast("binary"), 256).alias("hash"), "packed").orderBy("hash", "packed").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return kept.sparkSession.createDataFrame([], schema)
    centroids = np.array([np.frombuffer(r.packed, "<i4") for r in first], np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(_summed(centroids), "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r.cluster, r.dim): int(r.total) for r in sums}
        centroids = np.array([[total[c, d] // total[c, -1] for d in range(dims)] if (c, -1) in total else centroids[c].tolist() for c in range(len(centroids))], np.int64)
    by_cluster = kept.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {r.cluster: int(r.total) for r in by_cluster}
    said = {
        "cluster_inertia": [inertia.get(c, 0) for c in range(len(centroids))], "inertia": [sum(inertia.values())] * len(centroids),
        "centroid_sha256": [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()],
    }
    return kept.mapInArrow(_assigned(centroids, said), schema)
