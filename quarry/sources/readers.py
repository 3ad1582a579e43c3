"""Readers, all through Spark, so inputs may lie in any store that it opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import markdown_text
from quarry.operators.dialogue import TRAJECTORY

SKIPPED = r"(^|/)(cache|__pycache__|\.[^/]*)(/|$)"


def _path() -> Column:
    return F.col("_metadata.file_path")


def json_objects(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Every file of the name below root, one JSON object each, with its path; malformed files fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mode", "FAILFAST").json(root).select("*", _path().alias("path"))


def trajectories(spark: SparkSession, root: str, name: str = "dialogue_trajectory.json") -> DataFrame:
    """Trajectories with model and paper as their folders name them: .../model/paper/file."""
    rows = json_objects(spark, root, name, TRAJECTORY)
    return rows.withColumns({"folder_model": F.element_at(F.split("path", "/"), -3), "folder_paper": F.element_at(F.split("path", "/"), -2)})


def misplaced(rows: DataFrame) -> DataFrame:
    """Rows whose identity is not that of their folder."""
    return rows.filter(~F.col("target_model").eqNullSafe(F.col("folder_model")) | ~F.col("paper_id").eqNullSafe(F.col("folder_paper")))


def markdown_pages(spark: SparkSession, root: str, name: str = "doc_*.md") -> DataFrame:
    """(paper, file, page, text): whole files, pages numbered by the order of their names, in which doc_10 precedes doc_2."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("value").alias("text"), _path().alias("path"))
    rows = rows.select(F.element_at(F.split("path", "/"), -2).alias("paper"), F.element_at(F.split("path", "/"), -1).alias("file"), "text")
    return rows.withColumn("page", F.row_number().over(Window.partitionBy("paper").orderBy("file")))


def paper_texts(pages: DataFrame) -> DataFrame:
    """(paper, text): the cleaned pages of each paper in order, a mark before each."""
    marked = F.concat(F.lit("\n\n<!-- page "), F.col("page").cast("string"), F.lit(": "), F.col("file"), F.lit(" -->\n\n"), markdown_text(F.col("text")))
    per = pages.select("paper", F.struct("page", marked.alias("text")).alias("p")).groupBy("paper").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return per.select("paper", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), r"^\s+|\s+$", "").alias("text"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files below root, without caches and hidden ones."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.filter(~F.col("path").rlike(SKIPPED)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def flattened(rows: DataFrame, *groups: str) -> DataFrame:
    """Struct columns as columns group.key, scalars only."""
    names = [(g, f.name) for g in groups for f in rows.schema[g].dataType.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    rest = [c for c in rows.columns if c not in groups]
    return rows.select(*rest, *[F.col(f"{g}.{k}").alias(f"{g}.{k}") for g, k in names])
