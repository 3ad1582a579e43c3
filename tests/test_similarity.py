import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import similarity
from quarry.operators.similarity import similar_pairs


@pytest.mark.parametrize("sent", [0, 1_000_000])
@pytest.mark.parametrize("block", [8, 4096])
def test_pairs_equal_all_pairs_compared(spark, sent, block):
    random.seed(5)
    kinds = {}
    for i in range(240):
        base = kinds[random.randrange(i)][1] if i and random.random() < 0.7 else [f"w{random.randrange(60)}" for _ in range(random.randrange(1, 30))]
        kinds[i] = (random.choice(["a", "a", None]), [w if random.random() > 0.04 else f"w{random.randrange(60)}" for w in base] + ["every"])
    rows = [(g, i, t, "x") for i, (g, t) in kinds.items()] + [("a", 900, [], "x"), ("a", 901, None, "x")]
    df = spark.createDataFrame(rows, "g string, key long, tokens array<string>, n string").repartition(7)
    found = {(r.a, r.b): r.jaccard for r in similar_pairs(df, "key", "tokens", ["g"], 0.8, 5, block=block, most_sent=sent).collect()}
    sets = {i: (g, set(t)) for i, (g, t) in kinds.items()}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(a, b): share(x, y) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h == "a" and min(len(x), len(y)) >= 5 and share(x, y) >= 0.8}
    assert len(want) > 50 and found == want


def test_no_sets(spark):
    df = spark.createDataFrame([], "g string, key long, tokens array<string>")
    assert similar_pairs(df, "key", "tokens", ["g"], 0.8, 5).count() == 0
    assert similar_pairs(spark.range(3).select(F.lit("a").alias("g"), F.col("id").alias("key"), F.array(F.lit("w")).alias("tokens")), "key", "tokens", ["g"], 0.8, 5).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_rows_of_equal_tokens_stand_as_one(spark, block):
    random.seed(7)
    rows = {}
    for i in range(300):
        n = random.choice([5, 6, 12, 13, 14, 25, 40, 90, 180])
        t = list(random.choice(list(rows.values()))[1]) if i and random.random() < 0.8 else [f"w{random.randrange(10**6)}" for _ in range(n)]
        if random.random() < 0.7:  # some tokens go, some come, some change places
            t = [x for x in t if random.random() > 0.02] + [f"w{random.randrange(10**6)}" for _ in range(random.randrange(3))]
            t = t[1:] + t[:1]
        rows[i] = (random.choice(["a", "b"]), t)
    df = spark.createDataFrame([(g, i, t) for i, (g, t) in rows.items()], "g string, key long, tokens array<string>").repartition(5)
    found = sorted((r.g, r.a, r.b, r.jaccard) for r in similar_pairs(df, "key", "tokens", ["g"], 0.92, 5, block=block, once=True).collect())
    first = {}
    for i, (g, t) in rows.items():
        first.setdefault((g, tuple(t)), i)
    reps = [(i, g, set(t)) for (g, t), i in first.items() if len(set(t)) >= 5]
    want = sorted((g, a, b, len(x & y) / len(x | y)) for a, g, x in reps for b, h, y in reps if a < b and g == h and len(x & y) / len(x | y) >= 0.92)
    assert len(reps) < 290 and len(want) > 100 and found == want


def test_common_tokens_bring_no_sets_together(spark, monkeypatch):
    """Sets of common tokens that are not similar are neither dealt out nor met, and nothing that holds tokens is joined before pairs are known."""
    stored, kept = similarity.written, {}

    def seen(df, name, *a):
        kept[name] = (df._jdf.queryExecution().executedPlan().toString(), out := stored(df, name, *a))
        return out

    monkeypatch.setattr(similarity, "written", seen)
    monkeypatch.setattr(similarity, "discard", lambda *frames: None)
    random.seed(9)
    rows = [(i, [f"w{j}" for j in random.sample(range(300), 60)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, tokens array<string>").withColumn("g", F.lit("a"))
    similar_pairs(df, "key", "tokens", ["g"], 0.92, 5, block=16).collect()
    assert kept["token-hot"][1].isEmpty() and kept["token-near"][1].count() < 20
    assert not [name for name, (said, _) in kept.items() if "Join" in said]


def test_groups_hold_no_texts(spark, monkeypatch):
    """Claims in several groups belong together, near ones within their own; neither texts nor all sets are stored."""
    stored, kept = similarity.written, {}
    monkeypatch.setattr(similarity, "written", lambda df, name, *a: kept.setdefault(name, stored(df, name, *a)))
    monkeypatch.setattr(similarity, "discard", lambda *frames: None)
    base, other = [f"w{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(1, "a", other), (2, "a", base), (3, "b", base), (4, "b", [*base, "x"]), (5, "a", [*base, "y"]), (6, "c", [*base, "x"]), (7, None, base), (8, None, [*base, "z"]), (9, "a", ["few"]), (10, "b", ["few"]), (11, "a", []), (12, "a", None), (13, "a", ["few", "few"])]
    df = spark.createDataFrame(rows, "key long, g string, tokens array<string>").repartition(3)
    found = sorted(tuple(r) for r in similarity.duplicate_groups(df, "key", "tokens", ["g"]).collect())
    assert found == [*((i, 2, 6, "near") for i in (2, 3, 4, 5, 6, 7)), (9, 9, 2, "exact"), (10, 9, 2, "exact")]
    assert "token-sets" not in kept and sorted(r.id for r in kept["token-named"].collect() if r.id in (1, 9, 10)) == []


def test_pairs_within_a_component_are_not_compared(spark, monkeypatch):
    """Of a group of near copies each set is compared once; a chain of near copies stays whole."""
    compared, plain = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda near, *a: compared.append(near.count()) or plain(near, *a))
    texts = [[*(f"w{j}" for j in range(60)), f"x{i}"] for i in range(40)] + [[f"c{j}" for j in range(i, i + 60)] for i in range(12)]
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "key long, g string, tokens array<string>")
    found = {r.key: (r.group_id, r.n_members, r.kind) for r in similarity.duplicate_groups(df, "key", "tokens", ["g"]).collect()}
    assert found == {i: (0, 40, "near") for i in range(40)} | {i: (40, 12, "near") for i in range(40, 52)}
    assert sum(compared) < 150  # 40 of them make 780 pairs
