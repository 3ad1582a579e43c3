"""Judged turns as keyed state: what each dialogue's components, events and gaps stand at, in maps of a state store.

Every micro-batch reads and writes the entries that its turns touch, and no others. An entry costs a call to the store, however
small it is, so turns and events lie in `PARTS` entries a dialogue by a hash, and of a dialogue without state nothing is read. All inserts are idempotent: a turn that comes
again, an event or a gap that is known, change nothing. Turns may come in any order, within micro-batches and across them; a
component keeps its decisive marks by turn, so its status is always that of the turns seen so far in their own order, as
`quarry.operators.replay.states` gives it.

The session must keep state in RocksDB (`PROVIDER`), as maps need it.

Defined results: turns without a key or an order are left out; a turn without marks, events or missing components changes nothing;
of turns of the same order the first to come counts; an event belongs to its earliest turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.dialogue import BAD_STATES

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Entries that the turns of a dialogue share, and its events.
PARTS = 4
OUT = "kind string, id string, status string, at long, n_bad long, n_corrected long, n long"


def judged(turns: DataFrame, key: str, order: str, state: Column, covered: Column, missing: Column, events: Column) -> DataFrame:
    """The columns that `Turns` takes: key, at, kcs, marks (as replay.marks has them), events, missing."""
    none = F.array().cast("array<string>")
    c, m, bad = F.coalesce(covered, none), F.coalesce(missing, none), F.coalesce(state.isin(*BAD_STATES), F.lit(False))
    ids = F.array_union(c, m)
    marks = F.transform(ids, lambda k: F.when(bad, "bad").when(F.array_contains(c, k), "covered").otherwise("missing"))
    rows = turns.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), ids.alias("kcs"), marks.alias("marks"), F.coalesce(events, none).alias("events"), m.alias("missing"))
    return rows.filter("key is not null and at is not null")


def status_of(marks: dict[int, str]) -> tuple[str, int, int]:
    """(status, bad marks, corrections) of a component from its decisive marks by turn."""
    said = [marks[t] for t in sorted(marks)]
    fixed = [a == "bad" and b == "covered" for a, b in zip(said, said[1:], strict=False)]
    status = "missing" if not said else "hallucinated" if said[-1] == "bad" else "corrected" if fixed and fixed[-1] else "lit"
    return status, said.count("bad"), sum(fixed)


class Turns(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "part int", "at array<long>, missing array<array<string>>")
        self.components = handle.getMapState("components", "kc_id string", "at array<long>, mark array<string>")
        self.events = handle.getMapState("events", "part int", "event_id array<string>, at array<long>")
        self.counts = handle.getValueState("counts", "events long, gaps long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        marks: dict[str, dict[int, str]] = {}
        events: dict[str, int] = {}
        gaps: dict[int, list[str]] = {}
        fresh: set[int] = set()
        seen: dict[int, dict[int, list[str]]] = {}
        begun = self.counts.exists()

        def entry(state, part) -> dict:
            """The entry of a map as a dict, empty where there is none."""
            return dict(zip(*state.getValue((part,)), strict=True)) if begun and state.containsKey((part,)) else {}

        for part in rows:
            for at, kcs, said, named, missing in zip(part["at"], part["kcs"], part["marks"], part["events"], part["missing"], strict=True):
                at = int(at)
                if at % PARTS not in seen:
                    seen[at % PARTS] = entry(self.seen, at % PARTS)
                if at in seen[at % PARTS]:
                    continue
                fresh.add(at)
                seen[at % PARTS][at] = list(dict.fromkeys(missing))
                for kc, mark in zip(kcs, said, strict=True):
                    marks.setdefault(kc, {})[at] = mark
                for e in named:
                    events[e] = min(at, events.get(e, at))
                if len(missing):
                    gaps[at] = seen[at % PARTS][at]
        for p in {at % PARTS for at in fresh}:
            self.seen.updateValue((p,), (list(seen[p]), list(seen[p].values())))
        out = []
        for kc, new in marks.items():
            known = entry(self.components, kc)
            known |= {t: m for t, m in new.items() if m != "missing"}
            self.components.updateValue((kc,), (list(known), list(known.values())))
            status, bad, fixed = status_of(known)
            out.append(("component", kc, status, max(new), bad, fixed, len(known)))
        n_events, n_gaps = self.counts.get() if begun else (0, 0)
        shared: dict[int, dict[str, int]] = {}
        for e, at in events.items():
            shared.setdefault(zlib.crc32(e.encode()) % PARTS, {})[e] = at
        for p, new in shared.items():
            known = entry(self.events, p)
            earlier = {e: at for e, at in new.items() if e not in known or at < known[e]}
            n_events += len(new.keys() - known.keys())
            if earlier:
                known |= earlier
                self.events.updateValue((p,), (list(known), list(known.values())))
                out += [("event", e, "unresolved", at, 0, 0, 1) for e, at in earlier.items()]
        for at, missing in gaps.items():
            n_gaps += 1
            out.append(("gap", f"G_{at}", "open", at, 0, 0, len(missing)))
        if fresh:
            self.counts.update((n_events, n_gaps))
            out.append(("dialogue", "", "", max(fresh), n_events, n_gaps, len(fresh)))
        names = ["kind", "id", "status", "at", "n_bad", "n_corrected", "n"]
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", *names])

    def close(self) -> None:
        pass


def states(turns: DataFrame) -> DataFrame:
    """A stream of (key, kind, id, status, at, n_bad, n_corrected, n): what a micro-batch's turns changed, as it stands after them.

    kind `component`: as replay.states; `event` and `gap`: once each, at their turn; `dialogue`: in n_bad its events so far, in
    n_corrected its gaps, in n the batch's new turns. turns: as `judged` gives them.
    """
    return turns.groupBy("key").transformWithStateInPandas(Turns(), f"key long, {OUT}", "Update", "None")
