"""Metrics with exact numerators and denominators: means of papers, pooled ratios, roll-ups, pivots, plan status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator, null where the denominator is zero or less."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (numerator, denominator))
    return F.when(d > 0, n / d)


def rate(numerator: Column | str, denominator: Column | str, places: int | None = 4) -> Column:
    """The run-time form of a ratio: 0.0 for an empty denominator, rounded."""
    r = F.coalesce(ratio(numerator, denominator), F.lit(0.0))
    return r if places is None else F.round(r, places)


def means_and_pooled(runs: DataFrame, model: str, paper: str, numerator: str, denominator: str) -> DataFrame:
    """Per model: the mean over papers of each paper's mean over runs, its sample deviation, the pooled ratio, and what counted.

    runs: one row per run. Runs without a denominator have no value and enter neither mean; all enter the sums.
    """
    value = ratio(numerator, denominator)
    papers = runs.groupBy(model, paper).agg(
        F.avg(value).alias("_mean"), F.count(value).alias("_runs"), F.sum(numerator).alias("_num"), F.sum(denominator).alias("_den"))
    return papers.groupBy(model).agg(
        F.avg("_mean").alias("paper_mean"), F.stddev_samp("_mean").alias("std"), F.count("_mean").alias("valid_papers"), F.sum("_runs").alias("valid_runs"),
        F.sum("_num").alias("num_sum"), F.sum("_den").alias("den_sum"),
    ).withColumn("micro", ratio("num_sum", "den_sum"))


def pair_violations(rows: DataFrame, value: str, numerator: str, denominator: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose stored value is not numerator / denominator: strict runs raise if there are any."""
    expected, v = ratio(numerator, denominator), F.col(value)
    close = F.abs(v - expected) <= tolerance * F.greatest(F.lit(1.0), F.abs(v), F.abs(expected))
    return rows.filter(~((v.isNull() & expected.isNull()) | F.coalesce(close, F.lit(False))))


def unpivot(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row per metric, values as doubles."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def category(raw: Column, mapping: dict[str, str]) -> Column:
    """The category of a raw type; unknown types stay null, never guessed."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), raw) if mapping else F.lit(None).cast("string")


def category_pivot(events: DataFrame, keys: Sequence[str], raw: str, mapping: dict[str, str], everyone: DataFrame | None = None) -> DataFrame:
    """Per key a zero-filled count of each category, of unmapped types and of all; keys of `everyone` without events stay.

    One pass of conditional counts: no pivot job, and the map side combines.
    """
    found = category(F.col(raw), mapping)
    names = list(dict.fromkeys(mapping.values()))
    counts = events.groupBy(*keys).agg(*[F.count_if(found == c).alias(c) for c in names], F.count_if(found.isNull()).alias("unmapped"), F.count(F.lit(1)).alias("total"))
    if everyone is not None:
        counts = everyone.select(*keys).distinct().join(counts, list(keys), "left").fillna(0, [*names, "unmapped", "total"])
    return counts.withColumn("reconciled", sum((F.col(c) for c in names), F.col("unmapped")) == F.col("total"))


def path_counts(rows: DataFrame, path: Sequence[str]) -> DataFrame:
    """Counts per label path, null labels apart from any string, with the share of all rows."""
    counts = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def rolled_up(rows: DataFrame, dimension: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per value of the dimension and over all; is_total tells the total from a null value."""
    return rows.rollup(dimension).agg(*aggregates, F.grouping(dimension).cast("int").alias("is_total"))


def fixed_rates(rows: DataFrame, dimension: str, values: Sequence[str], failed: Column) -> DataFrame:
    """(value, total, failed, rate) for each listed value, also where no row has it."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(v,) for v in values], f"`{dimension}` string")  # as many rows as values listed
    counts = rows.filter(F.col(dimension).isin(*values)).groupBy(dimension).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
    return fixed.join(counts, dimension, "left").fillna(0, ["total", "failed"]).withColumn("rate", rate("failed", "total", None))


def plan(rounds: int, papers: DataFrame, models: DataFrame) -> DataFrame:
    """Every planned task: round (`single`, or round-01 and so on), paper and model. papers and models are short lists."""
    names = F.lit("single") if rounds <= 1 else F.explode(F.array(*[F.lit(f"round-{i:02d}") for i in range(1, rounds + 1)]))
    return papers.crossJoin(F.broadcast(models)).select(names.alias("round"), "*")


def with_status(planned: DataFrame, reports: DataFrame, keys: Sequence[str], complete: Column | None = None) -> DataFrame:
    """planned with status: missing without a report, incomplete where `complete` fails, else completed."""
    own = reports.withColumn("_there", F.lit(True)).withColumn("_complete", F.coalesce(complete if complete is not None else F.lit(True), F.lit(False)))
    joined = planned.join(own, list(keys), "left")
    return joined.withColumn("status", F.when(F.col("_there").isNull(), "missing").when(~F.col("_complete"), "incomplete").otherwise("completed")).drop("_there", "_complete")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; an identity check is empty where all is well."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def map_of_counts(rows: DataFrame, keys: Sequence[str], label: str, name: str) -> DataFrame:
    """Per key a map from label to count, labels in order. Labels are few."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_n")))).alias(name))


def differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float | None = None) -> DataFrame:
    """(keys, expected, actual) of keys whose values differ, or that one side lacks; numbers may differ by the tolerance."""
    a, b = expected.select(*keys, F.col(value).alias("expected"), F.lit(1).alias("_a")), actual.select(*keys, F.col(value).alias("actual"), F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    same = F.col("expected").eqNullSafe(F.col("actual"))
    if tolerance is not None:
        same = same | F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False))
    return both.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~same).drop("_a", "_b")
