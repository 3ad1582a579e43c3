"""The registered queries of the engine, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import calls, dialogues, metrics, more, planning, sequences, sets, states, texts, trees

PLANS: tuple[ModuleType, ...] = (metrics, sequences, sets, texts, states, dialogues, planning, calls, trees, more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The public functions of (spark, sf_dir) of the plan modules, by name."""
    return {name: f for m in PLANS for name, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_")}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in PLANS for name, sql in m.SQL.items()}
