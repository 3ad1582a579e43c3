"""Centroid clustering in exact integers, with block-norm screening.

A vector x and a centroid c are cut into segments of equal length. By Cauchy-Schwarz no segment adds more to their inner product than
the product of its two norms, so |x|^2 + |c|^2 - 2 * (sum of these products) never exceeds their squared distance. The norms of a
vector's segments, rounded up to whole numbers, are its compressed form: they are computed once, stored beside the vector, and give
the bound for every centroid by a product of an eighth of the size. A vector is measured against the centroid of its least bound
first; only centroids whose bound does not pass the best distance so far receive the exact one. All of it is done in longs.

Vectors are packed into tiles, each a row of a written table, where the rows lie; nothing is shuffled but the sums of a round: each
task adds up its own vectors per cluster, and those few numbers meet. The driver holds the centroids alone.

Defined results: vectors that are null, hold null or non-finite components, or have another length take no part; ids may be null or
repeat, every row is a vector of its own; rows of a null id come last among the starting centroids, equal ids go by their components;
with fewer vectors than clusters there are as many centroids as vectors; equal distances go to the smaller number; an empty cluster
keeps its centroid; an empty table gives an empty result. Whole numbers beyond 2^27 raise, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, written

#: Vectors of one tile.
TILE = 8192
#: Components of one segment.
SEGMENT = 8
#: Magnitude of a component up to which squared distances of up to 128 components fit a long.
MOST = 2**27


def rooted(squares: np.ndarray) -> np.ndarray:
    """The least whole numbers whose squares reach these."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r += r * r < squares
    r -= (r > 0) & ((r - 1) * (r - 1) >= squares)
    return r


def norms(whole: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The norm of every segment of every row, rounded up; a last segment may be shorter."""
    starts = np.arange(0, whole.shape[1], segment)
    return rooted(np.add.reduceat(whole * whole, starts, axis=1)) if len(whole) else np.zeros((0, len(starts)), np.int64)


def whole_vectors(column: pa.Array, dim: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, floor(by * x) of their components as longs)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.nan_to_num(column.value_lengths().cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1) == dim
    at = np.flatnonzero(fits)
    if not len(at):
        return at, np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes NaN
    real = np.isfinite(x).all(axis=1)
    x = np.floor(by * x[real])
    if len(x) and np.abs(x).max() > MOST:
        raise ArithmeticError(f"components beyond {MOST} after scaling: squared distances would not fit a long")
    return at[real], x.astype(np.int64)


def nearest(whole: np.ndarray, compressed: np.ndarray, squares: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance to it, how many exact distances were computed)."""
    n, k = len(whole), len(centroids)
    bound = squares[:, None] + (centroids * centroids).sum(axis=1) - 2 * (compressed @ norms(centroids, segment).T)
    measured = lambda rows, c: ((whole[rows] - c) ** 2).sum(axis=1)
    number = bound.argmin(axis=1)
    best = np.zeros(n, np.int64)
    for j in range(k):
        rows = np.flatnonzero(number == j)
        best[rows] = measured(rows, centroids[j])
    first, count = number.copy(), n
    for j in range(k):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        d = measured(rows, centroids[j])
        count += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], j
    return number, best, count


@dataclass
class Clustering:
    """Tiles of the vectors that take part, the final centroids, and what the last assignment adds up to."""

    tiles: DataFrame
    kind: str
    centroids: np.ndarray
    inertia: dict[int, int]
    exact: list[int]
    segment: int

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def _read(row: dict, dim: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer(row["whole"], "<i4").reshape(-1, dim).astype(np.int64)
    return whole, np.frombuffer(row["norms"], "<i8").reshape(len(whole), -(-dim // segment)), np.frombuffer(row["squares"], "<i8")


def tiles(vectors: DataFrame, id: str, vector: str, dim: int, by: int, segment: int = SEGMENT) -> DataFrame:
    """One row per tile: ids (a list), whole vectors, norms of their segments and squared lengths as binary; written."""
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TILE, 16 << 20):
            at, whole = whole_vectors(b.column(1), dim, by)
            if len(at):
                ids = b.column(0).take(pa.array(at))
                listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
                data = [whole.astype("<i4").tobytes(), norms(whole, segment).astype("<i8").tobytes(), (whole * whole).sum(axis=1).astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in data)], names=["ids", "whole", "norms", "squares"])

    return written(vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).mapInArrow(run, f"ids array<{kind}>, whole binary, norms binary, squares binary"), "clusters")


def first_centroids(packed: DataFrame, kind: str, k: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of "seed:id", in that order; each tile names its own k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(0)[i].as_py()
                whole = np.frombuffer(b.column(1)[i].as_py(), "<i4").reshape(len(ids), dim)
                said = [(x is None, "" if x is None else hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()) for x in ids]
                best = sorted(range(len(ids)), key=lambda j: (said[j], whole[j].tolist()))[:k]  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([said[j][0] for j in best]), pa.array([said[j][1] for j in best]), pa.array([whole[j].tolist() for j in best], pa.list_(pa.int64()))], names=["none", "said", "whole"])

    found = packed.select("ids", "whole").mapInArrow(run, "none boolean, said string, whole array<long>").orderBy("none", "said", "whole").limit(k).collect()
    return np.array([r.whole for r in found], np.int64).reshape(-1, dim)


def _summed(c: DataFrame, centroids: np.ndarray, dim: int, segment: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """By cluster: (vectors, distance, exact distances computed, sums of components); a task sends a row per cluster."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, far, exact = [[0] * dim for _ in range(k)], [0] * k, [0] * k, 0
        for b in batches:
            for row in b.to_pylist():
                whole, compressed, squares = _read(row, dim, segment)
                number, best, measured = nearest(whole, compressed, squares, centroids, segment)
                exact += measured
                for j in np.unique(number).tolist():
                    own = number == j
                    counts[j] += int(own.sum())
                    far[j] += sum(best[own].tolist())
                    sums[j] = [x + y for x, y in zip(sums[j], whole[own].sum(axis=0).tolist(), strict=True)]
        if any(counts):
            of = lambda j: [counts[j], far[j], exact if j == 0 else 0, *sums[j]]
            rows = [(j, i, str(x)) for j in range(k) for i, x in enumerate(of(j))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["cluster", "what", "x"])

    per = c.select("whole", "norms", "squares").mapInArrow(run, "cluster int, what int, x string")
    found: dict[int, dict[int, int]] = {}
    for r in per.groupBy("cluster", "what").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # dim + 3 numbers per cluster
        found.setdefault(r["cluster"], {})[r["what"]] = int(r["x"])
    return {j: (x[0], x[1], x[2], [x[3 + i] for i in range(dim)]) for j, x in found.items()}


def fit(vectors: DataFrame, id: str, vector: str, dim: int = 64, k: int = 8, rounds: int = 10, by: int = 1024, seed: int = 3, segment: int = SEGMENT) -> Clustering:
    """Rounds of assignment and exact floor(sum / count), over floor(by * x) of the components."""
    packed = tiles(vectors, id, vector, dim, by, segment)
    kind = vectors.schema[id].dataType.simpleString()
    centroids, exact = first_centroids(packed, kind, k, dim, seed), []
    if not len(centroids):
        return Clustering(packed, kind, centroids, {}, [], segment)
    for _ in range(rounds):
        found = _summed(packed, centroids, dim, segment)
        exact.append(sum(x[2] for x in found.values()))
        centroids = np.array([[s // found[j][0] for s in found[j][3]] if j in found and found[j][0] else c for j, c in enumerate(centroids.tolist())], np.int64)
    found = _summed(packed, centroids, dim, segment)
    exact.append(sum(x[2] for x in found.values()))
    return Clustering(packed, kind, centroids, {j: x[1] for j, x in found.items()}, exact, segment)


def assigned(c: Clustering) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector."""
    centroids, segment, dim = c.centroids, c.segment, c.centroids.shape[1]
    digests, inertia, whole_inertia = pa.array(c.digests(), pa.string()), np.array([c.inertia.get(j, 0) for j in range(len(centroids))], np.int64), sum(c.inertia.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(j)[i].as_py() for j, k in enumerate(("whole", "norms", "squares"), 1)}
                number, best, _ = nearest(*_read(row, dim, segment), centroids, segment)
                ids = b.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number.astype(np.int32)), pa.array(best), pa.array(inertia[number]), pa.array(np.full(len(ids), whole_inertia, np.int64)), digests.take(pa.array(number))],
                    names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return c.tiles.mapInArrow(run, f"id {c.kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
