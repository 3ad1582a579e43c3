"""Nulls in any column, ties, repeated rows, and columns whose names clash with those of the operators."""

import hashlib

from quarry.llm import ann, chat, clusters, decontaminate, langid, phrases, pieces, quality, secrets, sharding, simhash, topk, urls
from quarry.llm import queries as q

CLASH = "uid long, id string, key string, found int, rank int, shard int, fingerprint string, number int, host string, end int"


def clashing(spark, path, table, rows, schema):
    """The rows with columns that operators use inside, all null."""
    n = len(CLASH.split(","))
    spark.createDataFrame([(*r, *[None] * n) for r in rows], f"{schema}, {CLASH}").write.parquet(f"{path}/{table}.parquet")


def test_documents(spark, tmp_path):
    docs = [(None, None, None, None, None), (1, None, "en", None, 0), (None, "the of and to be", None, "s", None), (2, "", "", "", 0), (2, "", "", "", 0), (3, "the of and in was", "en", "s", 17), (3, "the of and in was", "en", "s", 17), (3, "le de la et un", "fr", "t", 14)]
    clashing(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    clashing(spark, tmp_path, "benchmark", [(None, None), (1, None), (None, "a b")], "item_id long, text string")
    clashing(spark, tmp_path, "labels", [(3, 1, None), (None, None, 1), (1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    d, n = str(tmp_path), len(docs)
    assert q.op1_balanced_shards(spark, d).count() == n
    assert sorted({r.lang_pred for r in q.op2_language_id(spark, d).collect()}) >= ["en"]
    assert all(r.round_trip for r in q.op3_sentencepiece(spark, d).collect())
    assert {r.n_hit for r in q.op5_benchmark_decontamination(spark, d).collect()} == {0}
    assert {r.base_sha256 for r in q.op8_secret_scan(spark, d).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert q.op9_simhash_near_dedup(spark, d).count() == n
    assert all(0 <= r.score <= 1 for r in q.op10_quality_rules(spark, d).collect())
    assert q.op12_phrase_collocations(spark, d).count() == 0


def test_other_tables(spark, tmp_path):
    clashing(spark, tmp_path, "embeddings", [(None, None, None), (0, [1.0, None], 1), (20, [0.5], 1), (20, [0.5], None), (21, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    clashing(spark, tmp_path, "pages", [(None, None, None), (1, "http://a.com/", None), (1, "http://a.com/", None), (None, "http://x.net/", "a.com")], "page_id long, url string, html string")
    clashing(spark, tmp_path, "conversations", [(None, None, None, None), (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x")], "conv_id long, turn long, role string, text string")
    d = str(tmp_path)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in q.op4_exact_top_k(spark, d).collect()) == [(20, 1, 20, 1024), (20, 1, 20, 1024), (20, 2, 21, 1024), (20, 2, 21, 1024)]
    assert q.op11_centroid_clustering(spark, d).count() == 0
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in q.op13_nearest_neighbours(spark, d).collect()) == []
    assert sorted((r.host, r.verdict) for r in q.op6_url_filter(spark, d).collect()) == [("", "allow"), ("a.com", "allow"), ("a.com", "allow"), ("x.net", "block")]
    assert sorted((r.conv_id or 0, r.n_turns) for r in q.op7_chat_format(spark, d).collect()) == [(-7, 2), (0, 1), (1, 3)]


def test_every_operator_states_its_results():
    for m in (ann, chat, clusters, decontaminate, langid, phrases, pieces, quality, secrets, sharding, simhash, topk, urls):
        assert "Defined results:" in m.__doc__, m.__name__
