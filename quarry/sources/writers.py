"""Sinks. Spark's committer makes each write whole or absent; small tables may be written as one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import csv_guarded


def csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, one_file: bool = False) -> None:
    """The columns in order, with a header; text that a spreadsheet would run is guarded. An unknown column is an error."""
    kinds = dict(rows.dtypes)
    out = rows.select(*[csv_guarded(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns or rows.columns])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_of_columns(*tables: DataFrame) -> DataFrame:
    """All rows, with the columns of all tables in the order they first appear; missing values are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def lines(rows: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """One text file of the lines in order: for graphs and reports, not for corpora."""
    rows.orderBy(*order).select(line).coalesce(1).write.mode("overwrite").text(path)


def appended(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
