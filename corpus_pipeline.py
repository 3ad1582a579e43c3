"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secret scans, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns what goes on; results are written as Parquet and read again in between.
Stages take the columns of documents alone, so other columns do no harm; all but the last return those columns.
Defined results: repeated rows, repeated and null ids are told apart by a row number of the stage; null and empty texts are
rejected by the first stage, as they hold no language; empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, pieces, secrets, simhash
from quarry.llm.common import bounded, written
from quarry.storage import discard, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold words of a learned language, of one or of several; a missing lang becomes the leading one found.

    Where no language could be learned, as no document has a lang, none is rejected.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2))
    if not model.langs:
        return docs
    kept = langid.identify(docs, model).filter(F.col("lang_pred") != "und")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, those whose sets of five-word shingles have a similarity of 0.8 or more: the one of the smallest id.

    Of rows with that id the least in the other columns stays; a number decides only between rows that are equal in all of them.
    """
    docs = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("uid")), "stage-dedup")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("said"), "lang", "source", "n_chars", "uid")
    found = simhash.near_copies(docs.withColumn("key", key), "key")
    gone = written(found.filter("id <> group").select(F.col("id.uid").alias("uid")), "stage-copies")
    discard(found)
    return docs.join(bounded(gone), "uid", "left_anti").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that equal texts of an id share: what a stage decides of a text, it decides of all of them."""
    return docs.select(*COLUMNS, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))).alias("key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up less than a twentieth of, by the contract's rule. The index goes when it has been searched."""
    docs = _keyed(docs)
    postings = decontaminate.index(docs, "key")
    found = decontaminate.judged(decontaminate.search(postings, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    bad = written(found.filter("contaminated").select(F.col("id").alias("key")), "stage-contaminated")
    discard(postings)
    return docs.join(bad, "key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials of a single owner masked; copied examples stay. Texts are searched once; where few hold live ones, none is shuffled."""
    docs = _keyed(docs)
    hit = written(secrets.with_candidates(docs).filter(F.size("found") > 0).select(F.monotonically_increasing_id().alias("uid"), "key", "source", "found"), "stage-secrets")
    found = written(secrets.spans(hit), "stage-spans")
    cuts = written(secrets.cuts(found).join(hit.select("uid", "key"), "uid").select("key", "cuts").dropDuplicates(["key"]), "stage-cuts")
    looked = docs.join(bounded(cuts), "key", "left").withColumn("text", secrets.masked(F.col("text"), F.col("cuts")))
    return looked.withColumn("n_chars", F.when(F.col("cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text again."""
    return pieces.encode(docs.select(*COLUMNS)).drop("text")


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination), ("secret_scan", secret_scan), ("sentencepiece", encoding)]

#: SQL can express neither the language model nor the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the table that the last stage reads is left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(after)
        discard(docs)  # the stage before has been read; documents themselves are no such table
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
