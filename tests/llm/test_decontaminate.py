import hashlib
import random
import re

from quarry.llm import decontaminate, queries


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w = tokens(text)
        hit, names = set(), set()
        for k, t in items:
            v = tokens(t)
            size = min(13, len(v))
            for s in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[s : s + size]:
                        hit |= set(range(p, p + size))
                        if k is not None:
                            names.add(str(k))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def tables(spark, path):
    random.seed(2)
    words = ["a", "b", "Cé", "d1", "e", "F"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(k, text(random.choice([0, 3, 13, 15, 30, 60]))) for k in range(12)] + [(None, text(14)), (3, text(20)), (50, None), (51, "rare words zq here")]
    docs = [(i, text(random.choice([0, 1, 50, 200]))) for i in range(60)] + [(60, None), (61, "")]
    for i in range(40):
        k, t = random.choice(items)
        docs.append((70 + i, f"{text(random.randint(0, 99))} {t or ''} {text(random.randint(0, 300))}"))
    docs += [docs[75]] * 3
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, id string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_query_matches_brute_force(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    assert sorted(map(tuple, queries.op5_benchmark_decontamination(spark, str(tmp_path)).collect())) == sorted(brute(docs, items))


def test_blocks_and_segments_do_not_change_results(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    small = decontaminate.index(spark.read.parquet(f"{tmp_path}/documents.parquet"), segment_words=500)
    found = decontaminate.judged(decontaminate.search(small, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block_bytes=300))
    got = sorted((int(r.id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == sorted(brute(docs, items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x y z filler filler q"), (2, "q " + "f " * 30 + "x"), (3, "q"), (4, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Q x")], "item_id long, text string")
    got = {r.id: r["items"] for r in decontaminate.search(decontaminate.index(docs.coalesce(1)), items, slop=5).collect()}
    assert got == {"1": ["9"], "2": [], "3": [], "4": []}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.op5_benchmark_decontamination(spark, str(tmp_path)).count() == 0
