"""Queries over trees of result files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import tree
from quarry.storage import shared_dir

SQL: dict[str, str] = {}


def tree_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a tree of files, source by source, read back: identity from the folders, fields from the files, malformed ones as rows."""
    root = f"{shared_dir(tree.register(spark))}/quarry-tree-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("target_model"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), "lang", "text")
    body = F.when(F.col("doc_id") % 50 == 7, F.lit("[cut off")).otherwise(F.to_json(F.struct("target_model", "paper_id", "lang", "text")))
    docs.select(F.col("target_model").alias("model"), F.col("paper_id").alias("paper"), body.alias("body")).write.format("result_tree").option("name", "document.json").mode("append").save(root)
    rows = tree.parsed(spark.read.format("result_tree").option("name", "document.json").load(root), "target_model string, paper_id string, lang string, text string")
    return rows.select("model", "paper", F.col("fields.paper_id").alias("paper_id"), F.sha2("fields.text", 256).alias("text_sha256"), F.col("error").isNotNull().alias("malformed"))


SQL["tree_round_trip"] = r"""
WITH d AS (SELECT source, 'd' || CAST(doc_id AS VARCHAR) AS paper, text, doc_id % 50 = 7 AS bad FROM documents)
SELECT coalesce(nullif(trim(regexp_replace(coalesce(source, ''), '[^\w.\-]+', '_', 'g'), '._'), ''), 'unknown_model') AS model, paper,
    CASE WHEN NOT bad THEN paper END AS paper_id, CASE WHEN NOT bad THEN sha256(text) END AS text_sha256, bad AS malformed
FROM d
"""
