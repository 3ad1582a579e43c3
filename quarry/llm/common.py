"""What the corpus operators share: ranks without a single-task sort, Arrow batches cut to a bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.storage import discard, kept, scratch, written

__all__ = ["bounded", "bucket_of", "discard", "kept", "ranked", "scratch", "slices", "small_batches", "tidy", "written"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of bounded rows and bytes, in order; a row of more bytes is a slice of its own.

    What a worker builds from a slice is bounded with it, whatever batch size the session sets; that setting is left alone.
    """
    for batch in batches:
        left = [batch]
        while left:
            b = left.pop()
            if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives free memory back after the last batch.

    Workers wait for later tasks, and what they hold while idle counts with the executor that then works without them.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for what is run inside; the session's own settings are put back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows up to which a table of short rows is sent to all tasks.
SENT_ROWS = 200_000


def bounded(df: DataFrame, most_rows: int = SENT_ROWS) -> DataFrame:
    """df, written, marked to be broadcast where it holds no more than most_rows rows."""
    return F.broadcast(df) if df.count() <= most_rows else df


def bucket_of(*keys: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def ranked(df: DataFrame, by: list[str], keys: list[str], tie: list[str], n: int, name: str = "rank", lead: list[Column] | None = None) -> DataFrame:
    """Gapless ranks from 0 within `by`, made without one task per group: by `lead`, then the hash of `keys`, `keys` and `tie`.

    Rows are split by the first bits of that hash into `n` buckets or more, so their order is the same for any n. Only counts per
    (by, lead, bucket) meet in a window, and a row is sorted with its bucket alone. `by` and `lead` hold no nulls.
    """
    lead = [F.lit(0)] if lead is None else lead
    bits = max(0, n - 1).bit_length()
    hash_ = F.xxhash64(*keys)
    df = df.withColumns({"_h": hash_.bitwiseXOR(F.lit(-(2**63)).cast("long")), "_b": F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("long"), **{f"_l{i}": x for i, x in enumerate(lead)}})
    first = [f"_l{i}" for i in range(len(lead))]
    counts = df.groupBy(*by, *first, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(*first, "_b").rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: f"_s{i}" for i, c in enumerate([*by, *first, "_b"])}
    starts = counts.select(*[F.col(c).alias(x) for c, x in renamed.items()], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, *first, "_b").orderBy("_h", *keys, *tie)))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(x) for c, x in renamed.items()])
    return within.join(starts, on).withColumn(name, (F.col("_start") + F.col("_r") - 1).cast("long")).drop("_h", "_b", "_r", "_start", *first, *renamed.values())
