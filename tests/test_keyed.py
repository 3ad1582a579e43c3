"""Keyed state and per-turn sinks: any order and repetition of turns, and a stop after any batch, end where the batch replay does."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import replay
from quarry.streaming import artifacts, keyed

SCHEMA = "dialogue long, turn long, turn_id string, question_id string, question_type string, state string, covered array<string>, missing array<string>, events array<string>"


def turns(seed, n=40):
    r = random.Random(seed)
    kinds = ["main", "detail_followup", "macro_main_question", "review_followup", None]
    some = lambda: r.sample(["k1", "k2", "k3"], r.randint(0, 2)) if r.random() > 0.1 else None
    return [(i % 3, i, f"T{i:03d}", f"Q{i % 7}" if r.random() > 0.2 else r.choice([None, ""]), r.choice(kinds), r.choice(["HALLUCINATION", "CORRECT", "MISLED", None]), some(), some(), [f"E{r.randint(0, 9)}"] if r.random() < 0.4 else None) for i in range(n)]


def source(spark, tmp_path, rows, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    own = spark.newSession()
    own.conf.set(*keyed.PROVIDER)
    return own, lambda: own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def changed(rows):
    return keyed.states(keyed.judged(rows, "dialogue", "turn", F.col("state"), F.col("covered"), F.col("missing"), F.col("events")))


def expected(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    marked = replay.marks(df, ["dialogue"], "turn", F.col("state"), F.col("covered"), F.col("missing"))
    out = {(r.dialogue, "component", r.kc_id, r.status, r.n_bad, r.n_corrected) for r in replay.states(marked, ["dialogue"], ["turn"]).collect()}
    events = replay.recorded(df.select("dialogue", "turn", F.explode("events").alias("event_id")), ["dialogue"], ["turn"])
    out |= {(r.dialogue, "event", r.event_id, "unresolved", r.turn) for r in events.collect()}
    gaps = replay.coverage_gaps(df, ["dialogue"], "turn", F.col("missing"))
    return out | {(r.dialogue, "gap", f"G_{r.turn_id}", "open") for r in gaps.collect()}


def found(spark, root):
    now = artifacts.latest(artifacts.stored(spark, root, "changes", f"key long, {keyed.OUT}"), ["key", "kind", "id"]).collect()
    of = lambda k: [r for r in now if r.kind == k]
    out = {(r.key, r.kind, r.id, r.status, r.n_bad, r.n_corrected) for r in of("component")}
    out |= {(r.key, r.kind, r.id, r.status, r["at"]) for r in of("event")}
    return out | {(r.key, r.kind, r.id, r.status) for r in of("gap")}, {r.key: (r.n_bad, r.n_corrected) for r in of("dialogue")}


def test_shuffled_and_repeated_turns_end_as_the_batch_replay(spark, tmp_path):
    rows = turns(1)
    mixed = rows + random.Random(3).sample(rows, 15)
    random.Random(2).shuffle(mixed)
    _, stream = source(spark, tmp_path, mixed, 4)
    artifacts.kept(changed(stream()), str(tmp_path / "out"), "changes", str(tmp_path / "check"), mode="update").awaitTermination()
    got, counts = found(spark, str(tmp_path / "out"))
    assert got == expected(spark, rows)
    assert counts == {k: (len({x[2] for x in got if x[0] == k and x[1] == "event"}), len({x[2] for x in got if x[0] == k and x[1] == "gap"})) for k in (0, 1, 2)}


@pytest.mark.parametrize("stop", [0, 2])
def test_stop_after_any_batch_and_start_again(spark, tmp_path, stop):
    rows = turns(7)
    _, stream = source(spark, tmp_path, rows, 3)

    class Stopped(Exception):
        pass

    def after(number):
        if number == stop:
            raise Stopped  # written, but not committed

    root, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name, what, mode in (("changes", lambda: changed(stream()), "update"), ("turns", stream, "append")):
        with pytest.raises(Exception, match="Stopped"):
            artifacts.kept(what(), root, name, check, after, mode).awaitTermination()
        artifacts.kept(what(), root, name, check, mode=mode).awaitTermination()
    assert found(spark, root)[0] == expected(spark, rows)
    sunk = artifacts.stored(spark, root, "turns", SCHEMA).drop("batch")
    assert sorted(map(repr, sunk.collect())) == sorted(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))
    # where to go on
    done = {(r.dialogue, r.question_id) for r in artifacts.completed(sunk, ["dialogue"]).collect()}
    assert done == {(r[0], r[3]) for r in rows if r[4] in artifacts.MAIN_KINDS and r[3]}
    at = {r.dialogue: (r.turn_no, r.last_turn_id) for r in artifacts.position(sunk, ["dialogue"]).collect()}
    assert at == {k: (max(r[1] for r in rows if r[0] == k), max(r[2] for r in rows if r[0] == k)) for k in (0, 1, 2)}


def test_what_is_written_down_counts_before_what_is_inferred(spark):
    sunk = spark.createDataFrame([(1, "Q1", "main"), (1, "Q2", "main"), (2, "Q3", "main"), (2, "Q4", "detail_followup"), (3, "", "main")], "d long, question_id string, question_type string")
    said = spark.createDataFrame([(1, "Q1"), (1, None)], "d long, question_id string")
    done = artifacts.completed(sunk, ["d"], said)
    assert {tuple(r) for r in done.collect()} == {(1, "Q1"), (2, "Q3")}
    plans = spark.createDataFrame([(1, "Q1", 1), (1, "Q2", 2), (1, "Q0", 2), (2, "Q3", 1)], "d long, question_id string, place int")
    assert {tuple(r) for r in artifacts.to_do(plans, done, ["d"]).select("d", "question_id", "position").collect()} == {(1, "Q0", 1), (1, "Q2", 2)}
    assert artifacts.stored(spark, "/tmp/quarry-not-there", "turns", "a long").count() == 0


class _Store:
    """A state store's handle in memory that counts the calls."""

    def __init__(self):
        self.calls, self.maps = 0, {}

    def of(self, name, *_):
        return _Map(self, self.maps.setdefault(name, {}))

    getMapState = getValueState = of  # noqa: N815


class _Map:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def called(self, x=None):
        self.store.calls += 1
        return x

    def containsKey(self, k):  # noqa: N802
        return self.called(k in self.rows)

    def getValue(self, k):  # noqa: N802
        return self.called(self.rows[k])

    def updateValue(self, k, v):  # noqa: N802
        self.called(self.rows.__setitem__(k, v))

    def exists(self):
        return self.called(() in self.rows)

    def get(self):
        return self.getValue(())

    def update(self, v):
        self.updateValue((), v)


def test_calls_to_the_store_do_not_grow_with_the_turns():
    def run(parts):
        store = _Store()
        turns, out = keyed.Turns(), []
        turns.init(store)
        for rows in parts:
            frame = pd.DataFrame([(at, ["k"], ["bad"], [f"E{at}"], ["k"]) for at in rows], columns=["at", "kcs", "marks", "events", "missing"])
            out += [x for f in turns.handleInputRows((1,), iter([frame]), None) for x in f.itertuples(index=False)]
        return store.calls, [tuple(x)[4:] for x in out if x.kind == "dialogue"]

    few, many = run([range(8)]), run([range(800)])
    assert many[0] <= few[0] + 2 * keyed.PARTS and many[1] == [(799, 800, 800, 800)] and few[1] == [(7, 8, 8, 8)]
    again = run([range(8), range(4, 12), range(12)])  # known turns, events and gaps count once
    assert again[1] == [(7, 8, 8, 8), (11, 12, 12, 4)]
