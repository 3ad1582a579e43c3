import math
import random

from pyspark.sql import functions as F

from quarry.llm import queries, topk


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 20 == 0:
            top = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(ok) if a != b and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(top)]
    return sorted(out)


def table(n=400):
    random.seed(4)
    rows = [(i, [random.choice([0.5, -0.25, 1.0, 0.013, -0.999]) for _ in range(6)]) for i in range(n)]
    rows += [(20, rows[20][1])] * 2 + [(1000 + i, [1.0] * 6) for i in range(60)]
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, [1.0, 2.0]), (2100, []), (None, [1.0] * 6)]
    return rows


def test_query_matches_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = [(i, None if v is None else [None if x is None else x for x in v]) for i, v in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op4_exact_top_k(spark, str(tmp_path)).collect())) == brute(f32)


def test_tiles_and_merge_levels_do_not_change_results(spark):
    rows = table(150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    assert sorted(map(tuple, topk.search(df, "vec_id", "v", F.col("vec_id") % 20 == 0, k=7, size=16, fan=2).collect())) == brute(rows, 7)


def test_large_components_stay_exact(spark):
    rows = [(0, [2**30, 1]), (1, [2**31, 5]), (2, [2**31, 6]), (3, [-(2**31), 7])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = [tuple(r) for r in topk.search(df, "id", "v", F.col("id") == 0, k=3).collect()]
    assert sorted(got) == [(0, 1, 2, 2**61 + 6), (0, 2, 1, 2**61 + 5), (0, 3, 3, -(2**61) + 7)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op4_exact_top_k(spark, str(tmp_path)).count() == 0


def test_queries_too_many_to_send_are_joined(spark):
    rows = table(200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    assert sorted(map(tuple, topk.search(df, "vec_id", "v", F.col("vec_id") % 20 == 0, k=5, size=16, fan=3, most_sent=0).collect())) == brute(rows, 5)


def test_settings_of_the_session_stay_as_they_are(spark, tmp_path):
    before = dict(spark.conf.getAll)
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "the of", "en", "s", 6), (2, "le de", "fr", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op2_language_id", "op3_sentencepiece", "op4_exact_top_k", "op5_benchmark_decontamination", "op9_simhash_near_dedup"):
        queries.queries()[name](spark, str(tmp_path)).count()
    assert dict(spark.conf.getAll) == before
