"""The replay of marks as a stream: per dialogue a state that each micro-batch moves on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(status: str | None, before: str | None, mark: str) -> tuple[str, str | None]:
    """(status, last decisive mark) of a component after one more mark."""
    if mark == "missing":
        return status or "missing", before
    if mark == "bad":
        return "hallucinated", "bad"
    return ("corrected" if before == "bad" else "lit"), "covered"


def replay(marks: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A stream of (key, kc_id, status): the components that a micro-batch touched, as they stand after it.

    marks: key (long), the order columns, kc_id, mark. Within a micro-batch rows are taken in order; across them, as they come.
    The state of a dialogue is its components' statuses, of the size of its graph.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, statuses, befores = state.get if state.exists else ([], [], [])
        now = {i: (s or None, b or None) for i, s, b in zip(ids, statuses, befores, strict=True)}
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        touched = {}
        for kc, mark in zip(rows["kc_id"], rows["mark"], strict=True):
            now[kc] = step(*now.get(kc, (None, None)), mark)
            touched[kc] = now[kc][0]
        state.update((list(now), [s or "" for s, _ in now.values()], [b or "" for _, b in now.values()]))
        yield pd.DataFrame({key: [k[0]] * len(touched), "kc_id": list(touched), "status": list(touched.values())})

    return marks.groupBy(key).applyInPandasWithState(fold, f"{key} long, kc_id string, status string", "ids array<string>, statuses array<string>, befores array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Counts per window and value of `by`; rows later than `late` do not count. An extension: the batch engine knows no event time."""
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), by).agg(F.count(F.lit(1)).alias("n"))
