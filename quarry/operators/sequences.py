"""Operators on ordered sequences: leads, running series, repair tasks, episodes, fills, islands, batches, schedules.

Windows are partitioned by the sequence's key (a dialogue, a user), so one sequence is sorted in one task and sequences are
dealt over all of them; no operator sorts the whole table in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _over(keys: Sequence[str], order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_next(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: dict[str, str]) -> DataFrame:
    """rows with columns[c] holding c of the following row; the last of a sequence has null."""
    w = _over(keys, order)
    return rows.withColumns({new: F.lead(c).over(w) for c, new in columns.items()})


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], counts: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """rows with running counts of conditions and of distinct values so far.

    A distinct count is the running sum of first occurrences, so no growing set is kept per row.
    """
    w = _over(keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, c in distinct.items():
        first = F.row_number().over(Window.partitionBy(*keys, c).orderBy(*order)) == 1
        rows = rows.withColumn(f"_{name}", (first & F.col(c).isNotNull()).cast("long"))
    rows = rows.withColumns({name: F.sum(F.coalesce(cond, F.lit(False)).cast("long")).over(so_far) for name, cond in counts.items()} | {name: F.sum(f"_{name}").over(so_far) for name in distinct})
    return rows.drop(*[f"_{name}" for name in distinct])


def repair_tasks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], root: Column, success: Column, budget: int = 3) -> DataFrame:
    """Per root: root_no, attempts up to the first success, succeeded, exhausted, span (rows from root to the last attempt counted).

    A root opens a task; the rows after it, up to the next root, are attempts. Later attempts than the first success do not count.
    """
    w = _over(keys, order)
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("root_no", F.sum(root.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("root_no > 0")
    own = rows.withColumn("_root", root).withColumn("_ok", success)
    at = own.groupBy(*keys, "root_no").agg(
        F.min(F.when(F.col("_root"), F.col("_at"))).alias("_start"), F.min(F.when(~F.col("_root") & F.col("_ok"), F.col("_at"))).alias("_done"), F.max("_at").alias("_end"))
    last = F.coalesce("_done", "_end")
    return at.select(*keys, "root_no", (last - F.col("_start")).alias("attempts"), F.col("_done").isNotNull().alias("succeeded"), (F.col("_done").isNull() & (F.col("_end") - F.col("_start") >= budget)).alias("exhausted"), (last - F.col("_start") + 1).alias("span"))


def correction_episodes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], opens: Column, fixes: Column) -> DataFrame:
    """Per key: n_opened, n_fixed, rate (0.0 when none opened), mean_delta (rows from first opening to the fix).

    An episode ends with a fix and may open again; the number of fixes before a row tells its episode.
    """
    w = _over(keys, order)
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_fix", fixes).withColumn("_open", opens)
    rows = rows.withColumn("_episode", F.coalesce(F.sum(F.col("_fix").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = rows.groupBy(*keys, "_episode").agg(F.min(F.when(F.col("_open"), F.col("_at"))).alias("_first"), F.min(F.when(F.col("_fix"), F.col("_at"))).alias("_done"))
    fixed = F.col("_done") > F.col("_first")
    return each.groupBy(*keys).agg(F.count("_first").alias("n_opened"), F.count_if(fixed).alias("n_fixed"), F.avg(F.when(fixed, F.col("_done") - F.col("_first"))).alias("mean_delta")).withColumn("rate", F.coalesce(F.try_divide("n_fixed", "n_opened"), F.lit(0.0)))


def concordance(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], level: Column, levels: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Per key the share of pairs in order whose level does not fall: n_pairs, n_concordant, score (null without pairs).

    level runs from 0 to levels - 1; rows without one are in no pair. Each row counts the earlier rows of each level at or below its
    own by running sums, so pairs are counted without being made. more: aggregates over all rows of a key, taken in the same pass.
    """
    before = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    more = more or {}
    rows = rows.withColumn("_level", level)
    lower = sum((F.when(F.col("_level") >= i, F.coalesce(F.count_if(F.col("_level") == i).over(before), F.lit(0))).otherwise(0) for i in range(levels)), F.lit(0))
    rows = rows.withColumns({"_earlier": F.when(F.col("_level").isNotNull(), F.count("_level").over(before)).otherwise(0), "_lower": lower})
    return rows.groupBy(*keys).agg(F.sum("_earlier").alias("n_pairs"), F.sum("_lower").alias("n_concordant"), *[c.alias(n) for n, c in more.items()]).withColumn("score", F.try_divide("n_concordant", "n_pairs"))


def forward_fill(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], marks: Column, value: Column, name: str) -> DataFrame:
    """rows with `name`: the value at the latest marked row so far, that value being null included; null before any mark."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(marks, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


def nearby(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], flag: Column, reach: int, name: str) -> DataFrame:
    """rows with `name`: whether any row within `reach` places, itself included, has the flag."""
    w = _over(keys, order).rowsBetween(-reach, reach)
    return rows.withColumn(name, F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1)


def nearest_fill(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, wanted: Column, reach: int = 5) -> DataFrame:
    """rows with `filled`: a wanted row without a value takes that of the nearest row within reach, the earlier of two as near.

    One pass over the given values; fills of other fills are left to a second call.
    """
    w = _over(keys, order)
    around = [x for d in range(1, reach + 1) for x in (F.lag(value, d).over(w), F.lead(value, d).over(w))]
    return rows.withColumn("filled", F.coalesce(F.col(value), F.when(wanted, F.coalesce(*around))))


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], label: str) -> DataFrame:
    """Runs of equal labels: keys, island (from 1), label, n, first and last place."""
    w = _over(keys, order)
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.col("_at") == 1)).cast("long"))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("n"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; Spark keeps k rows per group and task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(_over(keys, order))).filter(F.col(name) <= k)


def round_robin(rows: DataFrame, bucket: str, order: Sequence[Column | str], limit: int, bucket_order: Column | None = None) -> DataFrame:
    """One row of each bucket a pass, in bucket order, up to the limit. Rows beyond the limit in a bucket are never needed."""
    ranked = top_per_group(rows, [bucket], order, limit, "turn")
    return ranked.orderBy("turn", bucket_order if bucket_order is not None else F.col(bucket)).limit(limit)


def overlapping_batches(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int, overlap: int | None = None) -> DataFrame:
    """rows with `batch` (from 0), once for each batch a row is in: size rows each, sharing `overlap` with the next."""
    overlap = max(1, min(5, size // 5)) if overlap is None else overlap
    step = max(1, size - overlap)
    at = F.row_number().over(_over(keys, order)) - 1
    rows = rows.withColumn("_at", at).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / step)).cast("long")
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step)).cast("long"), F.least(F.floor(F.col("_at") / step).cast("long"), last)
    return rows.withColumn("batch", F.explode(F.sequence(F.least(low, high), high))).drop("_at", "_n")


def scheduled(rows: DataFrame, keys: Sequence[str], stream: Column, order: Sequence[Column | str], buckets: int) -> DataFrame:
    """Streams interleaved place by place, then cut into equal buckets: position (from 0) and bucket floor(position * buckets / n)."""
    rows = rows.withColumn("_stream", stream)
    rows = rows.withColumn("_turn", F.row_number().over(_over([*keys, "_stream"], order)))
    w = _over(keys, ["_turn", "_stream"])
    rows = rows.withColumn("position", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.withColumn("bucket", F.least(F.floor(F.col("position") * buckets / F.col("_n")).cast("int"), F.lit(buckets - 1))).drop("_stream", "_turn", "_n")


def running_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], template: str, name: str) -> DataFrame:
    """rows with an id of the keys and a running number within them."""
    return rows.withColumn(name, F.format_string(template, *[F.col(k) for k in keys], F.row_number().over(_over(keys, order))))


def recent_turns(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], text: Column, keep: int | None = 4, sep: str = "\n") -> DataFrame:
    """rows with `recent`: the texts of the `keep` rows before (all with None), joined in order."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding if keep is None else -keep, -1)
    return rows.withColumn("recent", F.array_join(F.collect_list(text).over(w), sep))
