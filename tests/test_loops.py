"""The loop over tables comes to what a plain loop comes to, also after a stop; group constraints name what is broken."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import constraints as C
from quarry.operators import loops

VERDICTS = ["accepted", "barred", "unusable", "too easy", None]


def verdict(plan, attempt):
    return random.Random(f"{plan}-{attempt}").choices(VERDICTS, [2, 1, 3, 3, 1])[0]


def plain(plans, target, attempts):
    """One plan after another, one attempt after another."""
    out = []
    for g in sorted({p[0] for p in plans if p[0] is not None}):
        pool = {}
        for _, plan, place in sorted((p for p in plans if p[0] == g and p[1] is not None), key=lambda p: (p[2], p[1])):
            pool.setdefault(plan, place)
        accepted = n = 0
        for plan in pool:
            before = None
            for a in range(1, attempts + 1):
                if accepted == target:
                    break
                n += 1
                said = verdict(plan, a) or "rejected"
                before = f"{said}<{before}"
                out.append((g, plan, a, said, before, n))
                if said in ("accepted", "barred"):
                    accepted += said == "accepted"
                    break
    return sorted(out)


def judge(rows):
    said = F.udf(verdict, "string")(F.col("p"), F.col("attempt"))
    return rows.withColumn("verdict", said).withColumn("feedback", F.concat(F.coalesce("verdict", F.lit("rejected")), F.lit("<"), F.coalesce("feedback", F.lit("None"))))


@pytest.mark.parametrize("target,attempts", [(3, 3), (1, 2), (100, 3)])
def test_equals_a_plain_loop(spark, tmp_path, target, attempts):
    r = random.Random(target)
    plans = [(r.randint(0, 3), f"p{i}", r.randint(0, 9)) for i in range(60)] + [(7, None, 1), (None, "x", 1), (0, "p0", 99), (0, "p0", 99)]
    df = spark.createDataFrame(plans, "g long, p string, place long")
    trials = loops.run(df, ["g"], "p", "place", judge, str(tmp_path / "loop"), target, attempts)
    want = plain(plans, target, attempts)
    assert sorted((x.g, x.p, x.attempt, x.verdict, x.feedback, x.question_no) for x in trials.collect()) == want
    known = df.filter("g is not null and p is not null").dropDuplicates(["g", "p"])
    for x in loops.outcomes(trials, ["g"], known, target, attempts).collect():
        own = [w for w in want if w[0] == x.g]
        assert x.n_questions == len(own) and x.n_tried == len({w[1] for w in own}) and x.n_accepted == sum(w[3] == "accepted" for w in own)
        assert x.stop == ("target_reached" if x.n_accepted == target else "pool_exhausted")


def test_goes_on_after_a_stop_without_asking_again(spark, tmp_path):
    plans = [(i % 2, f"p{i}", i) for i in range(20)]
    df, store, asked = spark.createDataFrame(plans, "g long, p string, place long"), str(tmp_path / "loop"), []

    def counted(stop):
        def one(rows):
            if len(asked) == stop:
                raise RuntimeError("stopped")
            asked.append(1)
            return judge(rows)

        return one

    with pytest.raises(RuntimeError, match="stopped"):
        loops.run(df, ["g"], "p", "place", counted(2), store, 3)
    trials = loops.run(df, ["g"], "p", "place", counted(None), store, 3)
    assert sorted((x.g, x.p, x.attempt, x.verdict, x.feedback, x.question_no) for x in trials.collect()) == plain(plans, 3, 3)


def test_empty_pool(spark, tmp_path):
    assert loops.run(spark.createDataFrame([], "g long, p string, place long"), ["g"], "p", "place", judge, str(tmp_path / "loop"), 3).count() == 0


def test_verdicts_of_a_model(spark):
    rows = spark.createDataFrame([('{"usable": true, "matched": true}',), ('{"usable": true, "too_easy": true, "reason": "all know"}',), ('{"usable": false, "reason": "vague"}',), ("x",), (None,), ('{"usable": true}',)], "a string")
    v, f = loops.by_model(F.col("a"))
    assert [tuple(r) for r in rows.select(v, f).collect()] == [("accepted", "accepted:"), ("barred", "barred: all know"), ("unusable", "unusable: vague"), ("unusable", "unusable:"), ("unusable", "unusable:"), ("too easy", "too easy:")]


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "c", "x"), (2, 1, "b", "x"), (2, 3, "a", None), (None, 1, None, "x"), (3, 1, "a", "x"), (3, 1, "a", "x")], "k long, n long, role string, m string")
    rules = {"size": C.between(2, 3), "run": C.consecutive(F.col("n")), "b": C.any_of(F.col("role") == "b"), "a<b": C.comes_before(F.col("role") == "a", F.col("role") == "b", F.col("n")), "two": C.distinct_values("m", 2), "named": C.all_of(F.col("m") != "")}
    got = {(r.k, r.rule) for r in C.violations(rows, ["k"], rules).collect()}
    assert got == {(2, "run"), (2, "a<b"), (2, "two"), (2, "named"), (None, "size"), (None, "b"), (None, "two"), (3, "run"), (3, "b"), (3, "two")}
    assert {tuple(r) for r in C.over_cap(rows, ["k"], ["m"], 1, "cap").collect()} == {(1, "cap"), (3, "cap")}
    ids = spark.createDataFrame([(1, ["a", "z"]), (2, ["a"]), (3, None)], "k long, ids array<string>")
    assert {tuple(r) for r in C.unknown(ids, ["k"], "ids", spark.createDataFrame([("a",)], "id string"), "ids").collect()} == {(1, "ids")}
