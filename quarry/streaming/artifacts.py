"""Per-turn sinks that survive a stop at any point: each micro-batch's rows in a folder of its number, written whole or again.

A micro-batch that was written but not yet committed when a run stopped is run again by the next one from its checkpoint; it
overwrites its own folder, so no row is there twice. What is done follows from the folders alone (`latest`, `completed`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The kinds of questions whose turns complete them.
MAIN_KINDS = ("main", "macro_main_question", "multi_hop_reasoning")


def kept(rows: DataFrame, root: str, name: str, checkpoint: str, after: Callable[[int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """A started stream that writes rows below root/name, a folder per micro-batch, and ends when its source is read. after: called with the number of each batch written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        if after:
            after(number)

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of a sink with the number of their batch; none before its first."""
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}")


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the changes of each key the last, without its batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def completed(turns: DataFrame, keys: Sequence[str], said: DataFrame | None = None) -> DataFrame:
    """(keys, question_id): the questions that need not be asked again. said: those that were written down; dialogues without any have theirs inferred from their main turns."""
    main = F.col("question_type").isin(*MAIN_KINDS) & (F.coalesce(F.col("question_id"), F.lit("")) != "")
    inferred = turns.filter(main).select(*keys, "question_id").distinct()
    if said is None:
        return inferred
    said = said.filter(F.coalesce(F.col("question_id"), F.lit("")) != "").select(*keys, "question_id").distinct()
    return said.unionByName(inferred.join(said.select(*keys).distinct(), list(keys), "left_anti"))


def position(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, turn_no, last_turn_id): where each dialogue goes on, by the number in its turns' ids."""
    number: Column = F.coalesce(F.regexp_extract("turn_id", r"(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return turns.withColumn("_n", number).groupBy(*keys).agg(F.max("_n").alias("turn_no"), F.max_by("turn_id", F.struct("_n", "turn_id")).alias("last_turn_id"))


def to_do(plans: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The planned questions that are not completed, in their order: position 1 is asked next. plans: keys, question_id, place."""
    left = plans.join(done, [*keys, "question_id"], "left_anti")
    return left.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "question_id")))
