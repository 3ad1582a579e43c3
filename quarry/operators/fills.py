"""Sequential fills: what a row takes depends on what rows before it have taken, so no window says it.

Rows are sorted by group and order and folded in tasks, a batch at a time; a task keeps `reach` rows behind and ahead of the one it
decides, whatever the length of a group. A group lies in one task, as its rows depend on each other in order.

Defined results: null keys are a group; ties in order go as the order columns leave them, so these should be unique; wanted null counts
as false; the first reach rows look back as far as there are rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(rows: Iterator[tuple], reach: int) -> Iterator[object]:
    """The filled value of each of some rows (group, value, wanted), in order.

    A wanted row without a value takes that of the nearest row of its group within reach which has one, given or filled, the earlier
    of two as near. Rows ahead count with the values they were given, since they are filled later.
    """
    behind: deque = deque(maxlen=reach)
    ahead: deque = deque()
    group: object = ahead  # no row's

    def first() -> object:
        nonlocal group
        g, value, wanted = ahead.popleft()
        if g != group:
            behind.clear()
            group = g
        if value is None and wanted:
            for d in range(1, reach + 1):
                before = behind[-d] if d <= len(behind) else None
                after = ahead[d - 1][1] if d <= len(ahead) and ahead[d - 1][0] == g else None
                if (value := after if before is None else before) is not None:
                    break
        behind.append(value)
        return value

    for row in rows:
        ahead.append(row)
        if len(ahead) > reach:
            yield first()
    while ahead:
        yield first()


def nearest_fill_in_turn(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, wanted: Column, reach: int = 5, name: str = "filled") -> DataFrame:
    """rows with `name`, filled in order, so that a filled row serves those behind it."""
    kind = rows.schema[value].dataType
    held = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.xxhash64(*keys).alias("part"), F.struct(*keys).alias("key"), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]).alias("at"), F.col(value).alias("value"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
    sorted_ = held.repartition("part").sortWithinPartitions("part", "key", "at")
    schema = f"row {sorted_.schema['row'].dataType.simpleString()}, filled {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.Array] = deque()

        def read() -> Iterator[tuple]:
            for b in batches:
                waiting.append(b.column("row"))
                yield from zip(b.column("key").to_pylist(), b.column("value").to_pylist(), b.column("wanted").to_pylist(), strict=True)

        done: list = []
        for x in folded(read(), reach):
            done.append(x)
            if len(done) == len(waiting[0]):  # a batch's rows are all decided, reach rows into the next
                own = waiting.popleft()
                yield pa.RecordBatch.from_arrays([own, pa.array(done, wanted_type)], names=["row", "filled"])
                done = []
        if done:
            raise AssertionError("rows were lost")

    from pyspark.sql.pandas.types import to_arrow_type

    wanted_type = to_arrow_type(kind)
    return sorted_.select("row", "key", "value", "wanted").mapInArrow(run, schema).select("row.*", F.col("filled").alias(name))
