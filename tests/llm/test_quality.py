import math
import random

import numpy as np

from quarry.llm import quality, queries


def test_paths_are_read_from_printed_trees():
    printed = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 0 <= 1.0E-3)
      Predict: 0.0
     Else (feature 0 > 1.0E-3)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 7.0)
     Predict: 0.0
    Else (feature 1 > 7.0)
     Predict: 1.0
"""
    assert quality.paths(printed, ("a", "b")) == [(("a", False, 2.5),), (("a", False, 0.001),), (("a", False, 2.5), ("a", True, 0.001)), (("a", True, 2.5),), (("b", False, 7.0),), (("b", True, 7.0),)]


def test_held_out_accuracy(spark, tmp_path):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 9)))
    docs, labels = [], []
    for i in range(600):
        good = random.random() < 0.6
        w = [word() for _ in range(random.randint(5, 80))]
        docs.append((i, " ".join(w) if good else random.choice([" ".join(x + "###" for x in w), " ".join(w[:2] * len(w)), "!! ".join(w).upper()]), 1.0))
        labels.append((i, int(good if random.random() < 0.97 else not good), 0))
    docs += [(900, None, 0.0), (901, "", 0.0), (902, "x" * 200_000, 0.0), (None, "y", 0.0), (5, "again", 0.0)]
    labels += [(3, 0, 0), (3, 1, 0), (None, 1, 0), (7, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op10_quality_rules(spark, str(tmp_path)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {i: q for i, q, _ in labels[:600]}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_one_kind_of_label_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.predicted for r in queries.op10_quality_rules(spark, str(tmp_path)).collect()} == {1}
    for t, s in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert queries.op10_quality_rules(spark, f"{tmp_path}/e").count() == 0


def test_compiled_rules_equal_row_by_row_evaluation(spark):
    random.seed(4)
    rows = [tuple(random.choice([0.0, 0.5, 1.0, random.random(), random.random() * 50]) for _ in quality.STATISTICS) for _ in range(300)]
    rules = []
    for _ in range(40):
        rule = tuple((random.choice(quality.STATISTICS), random.random() < 0.5, random.choice([0.5, random.random(), random.random() * 50])) for _ in range(random.randint(1, 3)))
        rules.append((rule, random.uniform(-2, 2)))
    ensemble = quality.Ensemble(0.3, tuple(rules))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    found = {r.i: r.s for r in df.select("i", quality.score(ensemble).alias("s")).collect()}
    for i, r in enumerate(rows):
        own = dict(zip(quality.STATISTICS, r, strict=True))
        total = ensemble.bias + sum(w for rule, w in rules if all(own[c] > x if above else own[c] <= x for c, above, x in rule))
        assert abs(found[i] - 1 / (1 + math.exp(-total))) < 1e-12


def test_statistics_equal_plain_counts(spark):
    texts = ["", "Hello, World! 12\n\nHello", "a  b\ta\n", "###$$ x x x", "É!é", "x" * 1000, "\n\n\n"]
    found = {r.i: r for r in quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(texts):
        n, words, lines = max(1, len(t)), t.split(), t.split("\n")
        share = lambda chars, t=t, n=n: sum(c in chars for c in t) / n
        want = (len(t), len(words), len(t) / max(1, len(words)), share("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), share("#$%&*|"), share("!"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("\n"), 1 - len(set(words)) / len(words) if words else 0.0, 1 - len(set(lines)) / len(lines))
        assert all(abs(found[i][c] - w) < 1e-12 for c, w in zip(quality.STATISTICS, want, strict=True)), t
