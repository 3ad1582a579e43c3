import os
import random

import corpus_pipeline as p
from quarry.llm import pieces
from quarry.storage import shared_dir

STEMS = {"en": ["the", "of", "tion", "ing", "wh", "ea", "st", "er"], "fr": ["le", "eux", "é", "oi", "que", "ou", "ai", "an"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, found int, id double"


def text(lang, n):
    return " ".join("".join(random.choices(STEMS[lang], k=random.randint(1, 4))) for _ in range(n))


def table(spark, path):
    random.seed(12)
    docs = {i: text(random.choice(list(STEMS)), random.randint(60, 120)) for i in range(150)}
    lang = {i: "fr" if "eux" in t else "en" for i, t in docs.items()}
    bench = text("en", 40)
    docs |= {200: None, 201: "", 202: "12 34 !!", 203: docs[3], 204: docs[3].upper().lower(), 205: docs[5] + " x", 206: f"{text('en', 30)} {bench}", 207: f"{text('en', 3000)} {bench.split(' ', 20)[0]}"}
    docs |= {208: f"{text('en', 70)} password=hunter22xyz {text('en', 30)}"} | {210 + i: f"{text('en', 90)} api_key=EXAMPLEkey123 {text('en', 5)}" for i in range(4)}
    docs[220] = text("en", 20_000)
    rows = [(i, t, lang.get(i), f"src{i % 5}", len(t or ""), "u", 1, 0.5) for i, t in docs.items()]
    rows += [rows[7], (None, text("fr", 80), None, None, None, "u", 1, 0.5)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_decisions_take_effect(spark, tmp_path):
    docs = table(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {}
    for name, stage in p.STAGES:
        before = frame
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
        gone[name] = ids(before) - ids(frame)
        if name != p.STAGES[-1][0]:
            assert tuple(frame.columns) == p.COLUMNS
        if name == "secret_scan":
            texts = {r.doc_id: r for r in frame.collect()}
    assert {200, 201, 202} <= gone["language_id"] and len(gone["language_id"]) <= 5
    assert gone["simhash_near_dedup"] == {203, 204, 205}
    assert gone["benchmark_decontamination"] == {206} and not gone["secret_scan"] and not gone["sentencepiece"]
    assert "hunter22" not in texts[208].text and "password=<secret> " in texts[208].text and texts[208].n_chars == len(texts[208].text)
    assert all(texts[210 + i].text == docs[210 + i] for i in range(4)) and texts[220].text == docs[220]
    assert None in texts and texts[None].lang in STEMS
    encoder = pieces.Encoder(pieces.load())
    last = frame.collect()
    assert len(last) == len(texts) and all(r.round_trip and encoder.decode(__import__("numpy").array(r.token_ids)) == texts[r.doc_id].text for r in last)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in p.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id or -1, r.n_tokens) for r in last)


def test_clean_texts_of_several_languages_stay_and_tables_are_removed(spark, tmp_path):
    table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = " ".join((text("en", 40), text("fr", 35), " ".join(random.choices(["стено", "прора", "новени"], k=25))))
    more = spark.createDataFrame([(900, mixed, None, "m", 0, "u", 1, 0.5)] + [(910 + i, " ".join(random.choices(["стено", "прора", "новени", "овра"], k=30)), "ru", "m", 0, "u", 1, 0.5) for i in range(40)], SCHEMA)
    docs.unionByName(more).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/more/benchmark.parquet")
    before = set(os.listdir(shared_dir(spark)))
    kept = {r.doc_id for r in p.run(spark, f"{tmp_path}/more").select("doc_id").collect()}
    assert 900 in kept and 3 in kept and not kept & {200, 201, 202, 203, 205, 206}
    left = {x for x in os.listdir(shared_dir(spark)) if x not in before}
    assert len(left) == 1 and left.pop().startswith("quarry-pipeline-secret_scan")


def test_nothing_is_rejected_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "the of", None, "s", 6), (2, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.language(spark, docs, "").count() == 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
