"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: from a bounded sample (`SAMPLE` rows per length, those of the smallest hash of the id) the mean, the leading principal axes and
rotations of them are learned that bring rotated vectors closest to their signs (iterative quantisation). A code holds 128 signs: of one
rotation of 128 axes, or of as many as fill it for shorter vectors, each learned from another start.

Index: every vector lies in a shard of up to 16,384 rows, one row of a written table, with its code cut into eight substrings of 16
bits. For each substring the shard holds its rows in the order of the substring's value, and where each value starts.

Search: a query probes a shard at radius 0, 1, 2, ... Two codes within radius 8a + b agree up to a bits on one of the first b + 1
substrings or up to a - 1 bits on one of the others (the pigeonhole principle), so step r looks up the values that differ in exactly
r div 8 bits in substring r mod 8, and after it every code within radius r has been seen. The search of a shard ends at the first
radius that holds `wanted` codes; all codes within that radius are ranked by exact distances of the original vectors. Shards' lists
of a query are merged some at a time. Queries are sent to the shards where they stay under a checked size; beyond it shards and blocks
of queries are dealt to the cells of a grid and meet there, so neither side is copied more often than the root of the other's number.

Defined results: rows without an id and vectors that are null, zero, or hold null or non-finite components take no part; vectors meet
only those of their own length; ties go to the smaller id; repeated rows are vectors of their own, and a query leaves out its own
row only; with fewer than k candidates all are returned, as a shard of fewer than `wanted` rows is ranked whole; vectors of fewer than
`SHORT` components are all ranked, their signs say too little; lengths that are not among the `LEARNED` commonest take random
rotations; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import kept, scratch, slices, written

BITS, SUB = 128, 16
SHARD = 16_384
#: Codes that the radius of a query must hold in each shard before it ends there.
WANTED = 1024
#: Rows (and, beside it, components) of the sample that rotations are learned from, and how many lengths have their own.
SAMPLE, COMPONENTS, LEARNED = 20_000, 1 << 21, 8
SHORT = 16
ROUNDS = 30
BLOCK = 2048
FAN = 16
#: Bytes of packed queries up to which they are sent to all tasks.
SENT = 32 << 20


SHARD_ROW = pa.schema([("number", pa.int64()), ("dim", pa.int32()), *((x, pa.binary()) for x in ("ids", "is_query", "matrix", "codes", "orders", "starts"))])
BLOCK_ROW = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((x, pa.binary()) for x in ("q_ids", "q_home", "q_at", "q_matrix", "q_codes"))])


class Rotation:
    """mean (dim) and axes (dim, BITS): a code is the signs of (x - mean) @ axes."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray) -> None:
        self.mean, self.axes = mean, axes

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, BITS / SUB) substrings of the codes."""
        bits = np.packbits((x - self.mean) @ self.axes >= 0, axis=1, bitorder="little")
        return bits.view("<u2")


def learned(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> Rotation:
    """Rotations of the principal axes of the sample, one after another until their signs fill the code."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    most = np.abs(centred).max(initial=0) or 1.0
    _, axes = np.linalg.eigh((centred / most).T @ (centred / most))
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    low, parts = (centred / most) @ axes, []
    for seed in range(-(-bits // axes.shape[1])):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return Rotation(mean, np.concatenate(parts, axis=1)[:, :bits])


def at_random(dim: int, bits: int = BITS) -> Rotation:
    return Rotation(np.zeros(dim), np.random.default_rng(dim).normal(size=(dim, bits)))


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id, vector of those that take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return vectors.filter(F.col(id).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))


def fit(rows: DataFrame) -> dict[int, Rotation]:
    """By length, the rotations of the commonest ones. rows: id, vector, as `usable` gives them."""
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().filter(F.col("dim") >= SHORT).orderBy(F.desc("count"), "dim").limit(LEARNED).collect()
    out = {}
    for r in lengths:
        most = min(SAMPLE, max(256, COMPONENTS // r.dim))
        seen = rows.filter(F.size("vector") == r.dim).orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow().column(0).combine_chunks()
        out[r.dim] = learned(seen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, r.dim))
    return out


def index(rows: DataFrame, asks: Column, model: dict[int, Rotation], size: int = SHARD) -> DataFrame:
    """One row per shard: number, dim, ids, is_query, matrix, codes, and of every substring the order of rows and the starts of values; written."""
    kind = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = rows.select("id", F.coalesce(asks, F.lit(False)).alias("asks"), F.col("vector").cast("array<float>" if kind == "<f4" else "array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}

        def shard(dim: int) -> pa.RecordBatch:
            nonlocal at
            ids, asked, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")  # the order in which ties go
            ids, asked, x = ids[order], asked[order], x[order]
            codes = (model.get(dim) or at_random(dim)).codes(x.astype(np.float64)) if dim >= SHORT else np.zeros((len(ids), 0), "<u2")
            orders = np.argsort(codes, axis=0, kind="stable").T
            starts = np.stack([np.searchsorted(c[o], np.arange((1 << SUB) + 1)) for c, o in zip(codes.T, orders, strict=True)]) if codes.shape[1] else np.zeros((0, 0))
            row = {"number": at, "dim": dim, "ids": ids.astype("<i8").tobytes(), "is_query": asked.astype("u1").tobytes(), "matrix": x.astype(kind).tobytes(), "codes": codes.tobytes(), "orders": orders.astype("<i4").tobytes(), "starts": starts.astype("<i4").tobytes()}
            at += 1
            return pa.RecordBatch.from_pylist([row], schema=SHARD_ROW)

        for b in slices(batches, 4096):
            dims = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat, ids, asked = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            first = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                row = np.flatnonzero(dims == dim)
                while len(row):
                    room = size - sum(len(p[0]) for p in held.get(dim, ()))
                    now, row = row[:room], row[room:]
                    held.setdefault(dim, []).append((ids[now], asked[now], flat[first[now][:, None] + np.arange(dim)]))
                    if room == len(now):
                        yield shard(dim)
            while sum(p[2].nbytes for ps in held.values() for p in ps) > 64 << 20:  # many lengths, or long vectors
                yield shard(max(held, key=lambda d: sum(p[2].nbytes for p in held[d])))
        for dim in list(held):
            yield shard(dim)

    dealt = rows.repartition(max(1, -(-rows.count() // size)))
    packed = written(dealt.mapInArrow(run, "number long, dim int, ids binary, is_query binary, matrix binary, codes binary, orders binary, starts binary"), "ann-shards")
    numbered = packed.select("number", (F.row_number().over(Window.orderBy("number")) - 1).cast("int").alias("shard"))  # as many rows as shards
    return written(packed.join(F.broadcast(numbered), "number").drop("number"), "ann-index")


def questions(packed: DataFrame, kind: str) -> DataFrame:
    """The queries in blocks: block, dim, q_ids, q_home and q_at (shard of each one, and its place there), q_matrix, q_codes; written."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["is_query"], "u1"))
                ids, cut = np.frombuffer(r["ids"], "<i8"), lambda k, n, t: [x.tobytes() for x in np.frombuffer(r[k], t).reshape(n, -1)[at]]  # noqa: B023
                cols = [pa.array([r["dim"]] * len(at), pa.int32()), pa.array([r["shard"]] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(ids[at])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cut("matrix", len(ids), kind), pa.binary()), pa.array(cut("codes", len(ids), "<u2"), pa.binary())], names=["dim", "home", "at", "id", "vector", "code"])

    single = written(packed.select("dim", "shard", "ids", "is_query", "matrix", "codes").mapInArrow(alone, "dim int, home int, at int, id long, vector binary, code binary"), "ann-asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in slices(batches, BLOCK):
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                row = pa.array(np.flatnonzero(dims == dim))
                ints = lambda i, t: b.column(i).take(row).to_numpy().astype(t).tobytes()  # noqa: B023, E731
                said = lambda i: b"".join(b.column(i).take(row).to_pylist())  # noqa: B023, E731
                yield pa.RecordBatch.from_pylist([{"block": number, "dim": dim, "q_ids": ints(3, "<i8"), "q_home": ints(1, "<i4"), "q_at": ints(2, "<i4"), "q_matrix": said(4), "q_codes": said(5)}], schema=BLOCK_ROW)
                number += 1

    dealt = single.repartition(max(1, -(-single.count() // BLOCK)))
    return written(dealt.mapInArrow(run, "block long, dim int, q_ids binary, q_home binary, q_at binary, q_matrix binary, q_codes binary"), "ann-blocks")


@lru_cache(maxsize=SUB + 1)
def masks(weight: int, width: int = SUB) -> np.ndarray:
    """All words of `width` bits with `weight` ones."""
    return np.array([sum(1 << i for i in x) for x in combinations(range(width), weight)], np.uint16)


def probed(code: np.ndarray, codes: np.ndarray, orders: np.ndarray, starts: np.ndarray, wanted: int) -> tuple[np.ndarray, int]:
    """(all rows whose code is within the least radius that holds `wanted` of them, that radius); all rows, if there are no more."""
    n, parts = codes.shape
    if n <= wanted or not parts:
        return np.arange(n), parts * SUB
    seen, within = np.zeros(n, bool), np.zeros(parts * SUB + 1, np.int64)
    rows, apart = [], []
    for r in range(parts * SUB + 1):
        part = r % parts
        values = (masks(r // parts) ^ code[part]).astype(np.int64)
        first, count = starts[part, values], starts[part, values + 1] - starts[part, values]
        has = count > 0
        first, count = first[has], count[has]
        if len(first):
            places = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            found = orders[part, places]
            found = found[~seen[found]]
            if len(found):
                seen[found] = True
                d = np.bitwise_count(codes[found] ^ code).sum(axis=1, dtype=np.int64)
                rows.append(found)
                apart.append(d)
                within += np.bincount(d, minlength=len(within))
        if within[: r + 1].sum() >= wanted:
            break
    rows, apart = np.concatenate(rows), np.concatenate(apart)
    return np.sort(rows[apart <= r]), r


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64) - q.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def search(vectors: DataFrame, id: str, vector: str, asks: Column, k: int = 10, wanted: int = WANTED, size: int = SHARD, fan: int = FAN, most_sent: int = SENT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `asks` (of the columns id and vector) holds, the k nearest of the other rows found, with their Euclidean distances."""
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    with scratch() as made:
        rows = usable(vectors, id, vector)
        packed = kept(made, index(rows, asks, fit(rows), size))
        blocks = kept(made, questions(packed, kind))
    n = packed.count()
    weight = blocks.agg(F.sum(F.octet_length("q_matrix") + F.octet_length("q_codes") + 2 * F.octet_length("q_ids"))).first()[0] or 0
    pairs = met(packed, blocks, n, sent=weight <= most_sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (s,) = b.slice(i, 1).to_pylist()
                ids, q_ids = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["q_ids"], "<i8")
                of = lambda key, t, rows: np.frombuffer(s[key], t).reshape(rows, -1)  # noqa: B023, E731
                codes, q_codes, x, q = of("codes", "<u2", len(ids)), of("q_codes", "<u2", len(q_ids)), of("matrix", kind, len(ids)), of("q_matrix", kind, len(q_ids))
                parts = codes.shape[1]
                orders, starts = np.frombuffer(s["orders"], "<i4").reshape(parts, len(ids)), np.frombuffer(s["starts"], "<i4").reshape(parts, (1 << SUB) + 1)
                home, at = np.frombuffer(s["q_home"], "<i4"), np.frombuffer(s["q_at"], "<i4")
                out = []
                for j in range(len(q_ids)):
                    near, _ = probed(q_codes[j], codes, orders, starts, max(wanted, k + 1))
                    if home[j] == s["shard"]:
                        near = near[near != at[j]]
                    d = distances(q[j], x[near])
                    best = np.lexsort((ids[near], d))[:k]
                    out.append((np.full(len(best), j), ids[near[best]], d[best]))
                j, found, d = (np.concatenate(p) for p in zip(*out, strict=True))
                cols = [home[j], at[j], q_ids[j], np.full(len(j), s["shard"], np.int32), found, d]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["home", "at", "query_id", "shard", "vec_id", "score"])

    lists = pairs.mapInArrow(run, "home int, at int, query_id long, shard int, vec_id long, score double")
    return merged(lists, k, n, fan)


def met(packed: DataFrame, blocks: DataFrame, n: int, sent: bool) -> DataFrame:
    """Every shard with every block of queries of its length, a pair per row."""
    columns = ["shard", "dim", "ids", "matrix", "codes", "orders", "starts", "q_ids", "q_home", "q_at", "q_matrix", "q_codes"]
    if sent:
        return packed.repartition(max(1, n)).join(F.broadcast(blocks), "dim").select(columns)
    side = max(1, int(n**0.5))  # cells of the grid on each side
    across = lambda c: F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias(c)
    down = packed.select("*", F.pmod(F.col("shard"), F.lit(side)).alias("i"), across("j"))
    over = blocks.withColumnRenamed("dim", "q_dim").select("*", across("i"), F.pmod(F.xxhash64("block"), F.lit(side)).cast("int").alias("j"))
    return down.join(over, ["i", "j"]).filter("dim = q_dim").select(columns)


def merged(lists: DataFrame, k: int, n: int, fan: int = FAN) -> DataFrame:
    """The k best of all of a query's lists, `fan` shards' lists at a time."""
    best = lambda x: F.slice(F.array_sort(x), 1, k)
    per = ["home", "at", "query_id", (F.col("shard") / fan).cast("int").alias("shard")]
    out = lists.groupBy(*per).agg(best(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
    groups = -(-n // fan)
    while groups > 1:
        out = out.groupBy(*per).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
        groups = -(-groups // fan)
    return out.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
