"""Constraints over groups of rows: what a thread's turns or a batch of plans must satisfy as a whole, all checked in one aggregation.

Each rule is an aggregate that must be true; one that is null fails. `violations` names the rules that a group breaks. Rules that
look at the row before need a column of `before`; caps per value are counted by value first, so that no group is gathered.

Defined results: rows of a null key form a group of their own; an empty group does not exist, so a rule on a least number of groups is a
rule on the table (`between` over no keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(least: int, most: int) -> Column:
    return F.count(F.lit(1)).between(least, most)


def any_of(condition: Column) -> Column:
    return F.bool_or(F.coalesce(condition, F.lit(False)))


def all_of(condition: Column) -> Column:
    return F.bool_and(F.coalesce(condition, F.lit(False)))


def distinct_values(column: Column | str, least: int) -> Column:
    return F.size(F.collect_set(column)) >= least if least > 2 else (F.min(column) != F.max(column)) if least == 2 else F.count(column) >= least


def consecutive(number: Column, start: int = 1) -> Column:
    """Numbers run from start without gaps or repeats: their count, least, greatest and sum leave no other way if none repeats."""
    return (F.min(number) == start) & (F.max(number) == start + F.count(F.lit(1)) - 1) & (F.count_distinct(number) == F.count(F.lit(1)))


def comes_before(first: Column, then: Column, order: Column) -> Column:
    """No row of the second kind stands before the last of the first; holds where either kind is missing."""
    last, next_ = F.max(F.when(first, order)), F.min(F.when(then, order))
    return F.coalesce(last < next_, F.lit(True))


def starts_with(condition: Column, order: Column) -> Column:
    return F.coalesce(F.min_by(condition, order), F.lit(False))


def ends_with(condition: Column, order: Column) -> Column:
    return F.coalesce(F.max_by(condition, order), F.lit(False))


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], column: str, name: str) -> DataFrame:
    """rows with the column's value in the row before."""
    return rows.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def violations(rows: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule that a group breaks."""
    checked = rows.groupBy(*keys).agg(*[F.coalesce(c, F.lit(False)).alias(r) for r, c in rules.items()])
    return checked.unpivot(list(keys), list(map(_quoted, rules)), "rule", "_ok").filter("NOT _ok").drop("_ok")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def over_cap(rows: DataFrame, keys: Sequence[str], by: Sequence[str | Column], cap: int, rule: str) -> DataFrame:
    """(keys, rule) of groups in which a value of `by` has more than cap rows."""
    names = [f"_b{i}" for i in range(len(by))]
    parts = rows.select(*keys, *[(F.col(b) if isinstance(b, str) else b).alias(n) for b, n in zip(by, names, strict=True)])
    return parts.groupBy(*keys, *names).count().filter(F.col("count") > cap).select(*keys, F.lit(rule).alias("rule")).distinct()


def unknown(rows: DataFrame, keys: Sequence[str], ids: str, known: DataFrame, rule: str) -> DataFrame:
    """(keys, rule) of groups that name an id (in an array column) which the table of known ones lacks."""
    named = rows.select(*keys, F.explode(ids).alias("_id"))
    return named.join(known.select(F.col(known.columns[0]).alias("_id")), "_id", "left_anti").select(*keys, F.lit(rule).alias("rule")).distinct()
