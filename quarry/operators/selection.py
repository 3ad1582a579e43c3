"""Sorts, limits, selections, set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_number(id: Column, missing: int = 10**9) -> Column:
    """The digits an id ends with, as a number; a natural sort orders by this and then by the id."""
    return F.coalesce(F.regexp_extract(id, r"(\d+)$", 1).try_cast("long"), F.lit(missing))


def all_digits(id: Column, missing: int = 10_000) -> Column:
    """All digits of an id read as one number."""
    return F.coalesce(F.regexp_replace(id, r"\D", "").try_cast("long"), F.lit(missing))


def shuffled(rows: DataFrame, id: str, seed: int) -> DataFrame:
    """rows in an order that a seed and the id decide, so every run and cluster agrees."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id)), id)


def active(rows: DataFrame, group: str, score: str, order: Sequence[Column | str], threshold: float, least: int, target: int) -> DataFrame:
    """rows chosen: those at the threshold, and the best `least` of each group whatever their score.

    If more than target are chosen, the best `least` of each group are locked and the rest is filled by score. Fewer than the
    minimums' sum are never returned. chosen_by says `threshold` or `minimum`.
    """
    own = Window.partitionBy(group).orderBy(F.desc(score), *order)
    rows = rows.withColumn("_rank", F.row_number().over(own)).filter((F.col(score) >= threshold) | (F.col("_rank") <= least))
    locked = rows.withColumn("_locked", F.col("_rank") <= least)
    minimum = locked.filter("_locked")
    n_min = minimum.agg(F.count(F.lit(1)).alias("_min"))  # one row
    rest = locked.filter("not _locked").orderBy(F.desc(score), *order).limit(target).withColumn("_place", F.row_number().over(Window.orderBy(F.desc(score), *order)))  # at most target rows
    fill = rest.crossJoin(F.broadcast(n_min)).filter(F.col("_place") <= F.greatest(F.lit(0), target - F.col("_min"))).drop("_place", "_min")
    chosen = minimum.unionByName(fill)
    return chosen.withColumn("chosen_by", F.when(F.col(score) >= threshold, "threshold").otherwise("minimum")).drop("_rank", "_locked")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each composite key, in the given order.

    min_by keeps one row per key and task, so a key of many rows never meets in one place.
    """
    place = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), place).alias("_row")).select(*keys, "_row.*")


def without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows whose keys `other` lacks."""
    return rows.join(other.select(*keys), list(keys), "left_anti")


def within(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows whose keys `other` has."""
    return rows.join(other.select(*keys), list(keys), "left_semi")


def appended(existing: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and those candidates whose keys are new, each key once."""
    return existing.unionByName(without(candidates, existing, keys).dropDuplicates(list(keys)), allowMissingColumns=True)


def merged_sequences(*arrays: Column | str) -> Column:
    """The arrays one after another, each item at its first place."""
    return F.array_distinct(F.concat(*[F.coalesce(F.col(a) if isinstance(a, str) else a, F.array()) for a in arrays]))


def review(n_wrong: Column, n_all: Column) -> Column:
    """What becomes of a question: none wrong, reject; all wrong, a person looks; else keep."""
    return F.when(n_wrong == 0, "reject").when(n_wrong == n_all, "human_review").otherwise("keep")


def stop_reason(available: Column, used: Column, exhausted: Column) -> Column:
    """Why a loop ends: every available item is used or exhausted, or null while one is left."""
    return F.when(F.size(F.array_except(available, F.array_union(used, exhausted))) == 0, "pool_exhausted")


def uncovered(required: DataFrame, *covering: DataFrame, key: str) -> DataFrame:
    """Keys that are required and covered by none of the others; empty where coverage is complete."""
    left = required.select(key).distinct()
    for other in covering:
        left = left.join(other.select(key), key, "left_anti")
    return left
