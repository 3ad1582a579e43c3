"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging of lists.

Vectors are packed into tiles, each one row of a written table. The vectors that ask are packed into tiles of their own, which
name each one's place among all; every one of those meets every tile of its length, a pair at a time. They are few, so where they
stay under a checked size they are sent to the tiles, and else pairs are joined on the tiles' numbers. A task holds one pair and
a block of its product at a time. Of each block the k best columns per query are selected; the lists of a query are merged some
tiles at a time, so no task gathers all of them.

Defined results: rows without an id and vectors that are null or hold null components take no part; vectors meet only those of
their own length; ties go to the smaller id; repeated rows are vectors of their own, and a query leaves out its own row only;
with fewer than k candidates all are returned; an empty table gives an empty result. Products of longs are exact where scores
fit a long; scores of doubles are rounded to `digits` before they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import discard, written

TILE = 8192
#: Queries multiplied at a time: a block of the product has so many rows, and a tile's vectors as columns.
ROWS = 256
FAN = 16
EXACT = float(2**53)
#: Bytes of packed queries up to which they are sent to all tasks rather than joined.
SENT = 32 << 20
TYPES = {"bigint": np.dtype("<i8"), "double": np.dtype("<f8")}


def tiles(vectors: DataFrame, id: str, vector: str, query: Column, size: int = TILE) -> DataFrame:
    """One row per tile and length: number, dim, ids, is_query and the matrix, all binary; written. vector: array of bigint or double."""
    kind = TYPES[vectors.schema[vector].dataType.elementType.simpleString()]
    known = F.coalesce(~F.exists(vector, lambda x: x.isNull()), F.lit(False))
    rows = vectors.filter(known & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("is_query"), F.col(vector).alias("vector"))
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat, ids, asks = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                whole = np.flatnonzero(dims == dim)
                for i in range(0, len(whole), size):
                    row = whole[i : i + size]
                    row = row[np.argsort(ids[row], kind="stable")]  # the order in which ties go
                    m = flat[starts[row][:, None] + np.arange(dim)] if dim else np.zeros((len(row), 0), kind)
                    yield pa.RecordBatch.from_pylist([{"tile": at, "dim": dim, "ids": ids[row].astype("<i8").tobytes(), "is_query": asks[row].astype("u1").tobytes(), "matrix": m.astype(kind).tobytes()}])
                    at += 1

    dealt = rows.repartition(max(1, -(-n // size)))
    packed = written(dealt.mapInArrow(run, "tile long, dim long, ids binary, is_query binary, matrix binary"), "tiles")
    numbered = packed.select("tile", (F.row_number().over(Window.orderBy("tile")) - 1).cast("int").alias("number"))  # as many rows as tiles
    done = written(packed.join(F.broadcast(numbered), "tile").select("number", "dim", "ids", "is_query", "matrix"), "tiles")
    discard(packed)
    return done


def asking(packed: DataFrame, kind: np.dtype, size: int = TILE) -> DataFrame:
    """The vectors that ask, packed by length: asking (a number), dim, q_ids, q_number and q_at (each one's tile and place in it) and q_matrix; written."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                at = np.flatnonzero(np.frombuffer(r["is_query"], "u1"))
                rows = np.frombuffer(r["matrix"], kind).reshape(len(r["is_query"]), r["dim"])[at]
                ids = np.frombuffer(r["ids"], "<i8")[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dim"]] * len(at), pa.int64()), pa.array([r["number"]] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(ids), pa.array([x.tobytes() for x in rows], pa.binary())],
                    names=["dim", "number", "at", "id", "vector"],
                )

    alone = written(packed.mapInArrow(single, "dim long, number int, at int, id long, vector binary"), "asking")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            dims, numbers, at, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for dim in np.unique(dims).tolist():
                whole = np.flatnonzero(dims == dim)
                for i in range(0, len(whole), size):
                    row = whole[i : i + size]
                    yield pa.RecordBatch.from_pylist([{
                        "asking": number, "dim": dim, "q_ids": ids[row].astype("<i8").tobytes(), "q_number": numbers[row].astype("<i4").tobytes(), "q_at": at[row].astype("<i4").tobytes(),
                        "q_matrix": b"".join(x.as_py() for x in b.column(4).take(pa.array(row))),
                    }])
                    number += 1

    dealt = alone.repartition(max(1, -(-alone.count() // size)))
    done = written(dealt.mapInArrow(run, "asking long, dim long, q_ids binary, q_number binary, q_at binary, q_matrix binary"), "asking")
    discard(alone)
    return done


def _best(q: np.ndarray, c: np.ndarray, k: int, own: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, column, score) of each query's k best columns; own: each query's own column, or -1; columns are in tie order."""
    if q.dtype.kind == "f":
        score = np.round(q @ c.T, digits)
        least = -np.inf
    else:
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
        score = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if most < EXACT else q @ c.T
        least = np.iinfo(np.int64).min
    has = np.flatnonzero(own >= 0)
    real = np.ones(score.shape, bool)
    real[has, own[has]] = False
    take = min(k, score.shape[1])
    bound = np.partition(np.where(real, score, least), score.shape[1] - take, axis=1)[:, score.shape[1] - take, None]
    rows, cols = np.nonzero((score >= bound) & real)
    found = score[rows, cols]
    order = np.lexsort((cols, -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], found[keep]


def search(vectors: DataFrame, id: str, vector: str, query: Column, k: int = 20, size: int = TILE, fan: int = FAN, digits: int = 12, most_sent: int = SENT, items: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `query` holds, the k other rows of the highest inner product, or those of `items`, which has the same columns."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind, score_type = TYPES[element], {"bigint": "long", "double": "double"}[element]
    packed = tiles(vectors, id, vector, query, size)
    asks, apart = asking(packed, kind, size), items is not None
    if apart:
        discard(packed)
        packed = tiles(items, id, vector, F.lit(False), size)
    n = packed.count()
    weight = asks.agg(F.sum(F.octet_length("q_matrix") + 2 * F.octet_length("q_ids"))).first()[0] or 0
    columns = ["asking", "number", "dim", "q_ids", "q_number", "q_at", "q_matrix", "ids", "matrix"]
    if weight <= most_sent:
        pairs = packed.repartition(max(1, n)).join(F.broadcast(asks), "dim").select(columns)
    else:
        to = asks.withColumnRenamed("dim", "q_dim").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
        pairs = to.join(packed, "number").filter("q_dim = dim").select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                at, home = np.frombuffer(r["q_at"], "<i4"), np.frombuffer(r["q_number"], "<i4")
                q, c = np.frombuffer(r["q_matrix"], kind).reshape(len(q_ids), r["dim"]), np.frombuffer(r["matrix"], kind).reshape(len(ids), r["dim"])
                for j in range(0, len(q), ROWS):
                    part = slice(j, j + ROWS)
                    row, col, score = _best(q[part], c, k, np.where((home[part] == r["number"]) & (not apart), at[part], -1), digits)
                    row = row + j
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (home[row], at[row], q_ids[row], np.full(len(row), r["number"], np.int32), ids[col], score)], names=["home", "at", "query_id", "number", "vec_id", "score"]
                    )

    lists = pairs.mapInArrow(run, f"home int, at int, query_id long, number int, vec_id long, score {score_type}")
    best = lambda x: F.slice(F.array_sort(x), 1, k)
    order = -F.col("score").cast("decimal(20,0)") if score_type == "long" else -F.col("score")
    entry = F.struct(order.alias("o"), "vec_id", "score")
    per = ["home", "at", "query_id", (F.col("number") / fan).cast("int").alias("number")]
    merged = lists.groupBy(*per).agg(best(F.collect_list(entry)).alias("top"))  # lists of `fan` tiles at a time
    groups = -(-n // fan)
    while groups > 1:
        merged = merged.groupBy(*per).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
        groups = -(-groups // fan)
    return merged.select("query_id", F.posexplode("top").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
